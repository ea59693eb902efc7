"""The quota gate over files, restarts and months, and tables merged by touched buckets."""

from datetime import datetime

import pytest

from formloom.sinks import buckets as K
from formloom.streaming import quota as Q

CALLS = "account string, plan string, event_id long, ts timestamp"


def judged(rows, quotas):
    used, out = {}, {}
    for account, plan, i, ts in rows:
        key, quota = (account or "", ts.strftime("%Y-%m")), quotas.get(plan, quotas["free"])
        n = used.setdefault(key, 0)
        good = quota is None or n < quota
        out[i] = ("CHARGED" if good else "BLOCKED", n, quota)
        used[key] += good
    return out


def test_quota_over_files_and_restarts(spark, tmp_path):
    quotas = {"free": 3, "pro": 5, "enterprise": None}
    day = lambda m, n: datetime(2024, m, 1 + n // 24, n % 24)
    plans = {"a": "free", "b": "pro", "c": "enterprise", "d": "unknown", None: None}
    files = []
    for m in (1, 2, 4):
        for part in (0, 1):
            files.append([(a, plans[a] if not (a == "b" and n > 20) else "free", len(files) * 1000 + n * 10 + k, day(m, part * 40 + n)) for n in range(0, 40, 3) for k, a in enumerate(plans)])
    folder, out = str(tmp_path / "calls"), str(tmp_path / "out")
    for n, rows in enumerate(files):
        spark.createDataFrame(rows[::-1], CALLS).coalesce(1).write.mode("append").parquet(folder)
        if n in (1, 2, 5):  # two files in the first run, one in the second, three in the last
            stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(folder)
            got = Q.run_gate(spark, stream, out, quotas)
            done = [r for f in files[: n + 1] for r in sorted(f, key=lambda r: (r[3], r[2]))]
            rows = got.collect()
            assert len(rows) == len(done)
            assert {r.event_id: (r.verdict, r.used, r.quota) for r in rows} == judged(done, quotas)
    before = spark.conf.get(Q.STORE)
    spark.conf.set(Q.STORE, Q.ROCKS)
    kept = {(r.key.account, r.key.period) for r in spark.read.format("statestore").option("stateVarName", "charged").load(f"{out}/state").collect()}
    spark.conf.set(Q.STORE, before)
    assert {p for _, p in kept} == {"2024-04"} and len(kept) == len(plans)  # state went with its months


def test_month_end():
    assert [Q.month_end(p) for p in ("2024-02", "2024-12")] == [1709251200000, 1735689600000]


ROW = "k string, v int, version int"


def read(df):
    return sorted(((r.k, r.v, r.version) for r in df.collect()), key=str)


def test_merge_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.createDataFrame([(f"k{i}", i, 1) for i in range(400)] + [(None, -1, 1)], ROW)
    assert len(K.merge_touched(spark, path, base, ["k"], "version", 16)["touched"]) == 16
    files = set(tmp_path.rglob("*.parquet"))
    change = spark.createDataFrame([("k7", 70, 2), (None, -2, 2), ("k8", 0, 0)], ROW)
    done = K.merge_touched(spark, path, change, ["k"], "version")
    assert len(done["touched"]) <= 3 and len({f.parent for f in set(tmp_path.rglob("*.parquet")) - files}) == len(done["touched"])
    expected = {f"k{i}": (i, 1) for i in range(400)} | {"k7": (70, 2), None: (-2, 2)}
    assert read(K.read_version(spark, path)) == sorted(((k, *v) for k, v in expected.items()), key=str)
    assert read(K.read_version(spark, path, 1)) == read(base)
    assert K.merge_touched(spark, path, change.limit(0), ["k"], "version")["touched"] == [] and K.versions(spark, path) == [1, 2]
    wide = spark.createDataFrame([("k9", 9, 3, "new")], f"{ROW}, more string")
    K.merge_touched(spark, path, wide, ["k"], "version")
    assert {r.k: r.more for r in K.read_version(spark, path).where("k IN ('k9', 'k1')").collect()} == {"k9": "new", "k1": None}
    before = read(K.read_version(spark, path).drop("more"))
    assert K.clean_versions(spark, path, 1) > 0 and K.versions(spark, path) == [3]
    assert read(K.read_version(spark, path).drop("more")) == before
    with pytest.raises(ValueError, match="kept by k"):
        K.merge_touched(spark, path, change, ["v"], "version")


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second writer of one version is refused, and what it wrote is not seen; tried again, it goes in."""
    path = str(tmp_path / "table")
    K.merge_touched(spark, path, spark.createDataFrame([("a", 1, 1)], ROW), ["k"], "version", 4)
    commit = K._commit

    def late(spark, path, version, content):
        monkeypatch.setattr(K, "_commit", commit)
        K.merge_touched(spark, path, spark.createDataFrame([("b", 2, 1)], ROW), ["k"], "version")
        commit(spark, path, version, content)

    monkeypatch.setattr(K, "_commit", late)
    mine = spark.createDataFrame([("c", 3, 1)], ROW)
    with pytest.raises(K.WriterConflict):
        K.merge_touched(spark, path, mine, ["k"], "version")
    assert read(K.read_version(spark, path)) == [("a", 1, 1), ("b", 2, 1)]
    K.merge_touched(spark, path, mine, ["k"], "version")
    assert read(K.read_version(spark, path)) == [("a", 1, 1), ("b", 2, 1), ("c", 3, 1)]
    assert K.clean_versions(spark, str(tmp_path / "none")) == 0
