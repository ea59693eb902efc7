"""Part of formloom."""
