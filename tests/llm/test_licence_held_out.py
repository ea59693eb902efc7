"""What the licence classifier is trained on holds out whole names and phrases, and the corpus' own notices."""

import duckdb
import pytest

from formloom.llm import licence

DATA = "/root/testdata/sf0.01"


def test_nothing_held_out_is_trained_on():
    rows = licence.training_rows()
    trained, held = ({t for t, _, h in rows if h == which} for which in (False, True))
    assert not trained & held and len(held) > 200
    trained -= {s for f in licence.TEMPLATES for s in licence._sentences(f)}  # a licence's own text may be such a notice
    for family, names in licence.NAMES.items():
        name = names[licence.HELD_NAME]
        built = {p.format(name) for p in licence.PHRASES}
        assert not built & trained and built & held
        for n in licence.HELD_PHRASES:
            assert not {licence.PHRASES[n].format(x) for x in names} & trained


def test_corpus_notices(spark):
    """The corpus' notices are in no row of the training; all are found by their family, and nothing else is taken for one."""
    lines = duckdb.sql(rf"SELECT DISTINCT trim(l) AS l FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM '{DATA}/documents.parquet') WHERE regexp_matches(l, '^\s*(Licensed|Released|This work is licensed) under ')").fetchall()
    assert lines and not {x for (x,) in lines} & {t for t, _, _ in licence.training_rows()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.n_notices for r in licence.licences(docs, licence.train(spark)).collect()}
    has = {i: any(x in (t or "") for (x,) in lines) for i, t in docs.select("doc_id", "text").collect()}
    recall = sum(got[i] > 0 for i, v in has.items() if v) / sum(has.values())
    alarms = sum(got[i] > 0 for i, v in has.items() if not v)
    print(f"corpus: recall {recall:.3f} of {sum(has.values())}, false alarms {alarms}")
    assert recall >= 0.95 and alarms <= 1


@pytest.mark.parametrize(("family", "text"), [("agpl", "You may copy this under the GNU Affero General Public License."), ("isc", "This package comes under the ISC license."), ("zlib", "The sources are covered by the zlib license."), ("epl-2.0", "Everything here is offered under the Eclipse Public License 2.0.")])
def test_newer_families(spark, family, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licence.licences(docs, licence._trained(spark.sparkContext.applicationId)).first().families == family
