import pytest
from pyspark.sql import functions as F

from cairn.operators import invalidation as I

PAGES = "path string, holds array<string>, made_with map<string, string>, indexed boolean"


def test_a_rule_change_selects_its_own_pages(spark):
    old = [{"glob": "a/**", "role": "knowledge"}, {"glob": "b/**", "role": "ignored"}]
    new = [*old[:1], {"glob": "a/x/*", "type": "note"}]
    rows = [("a/1", ["m"], {"m": "1"}, True), ("a/x/2", [], {}, True), ("b/3", None, None, False), ("c/4", ["m"], None, True), ("a/5", ["m"], {"m": "2"}, True), ("c/6", ["m"], {}, False), ("d", None, {"m": "1"}, None)]
    pages = I.policies(spark.createDataFrame(rows, PAGES), old, "path", ("role", "type"))
    got = {r["path"]: r["reasons"] for r in I.stale_pages(pages, new, {"m": "2"}).collect()}
    assert got == {"a/1": ["m"], "a/x/2": ["rules"], "b/3": ["rules"], "c/4": ["m"]}
    assert I.stale_pages(pages, old, {"m": "1"}).select("path").collect()[0]["path"] in ("a/5", "c/4")
    assert I.stale_pages(pages.limit(0), new, {}).count() == 0


def test_fingerprints_tell_lists_apart(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("1:a", "b"), ("a", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(I.fingerprint(F.col("x"), F.col("y")).alias("f")).distinct().count() == len(rows)


def test_marked_facts_follow_their_id(spark):
    kind = "page int, line int, item_id string, line_hash string"
    old = spark.createDataFrame([(1, 1, "m1", "h1"), (1, 2, None, "h2"), (1, 3, None, "h2"), (1, 4, "m2", "h4"), (2, 1, None, "h1")], kind)
    new = spark.createDataFrame([(1, 5, "m1", "h9"), (1, 2, None, "h2"), (1, 6, "m2", "h4"), (1, 7, None, "h7"), (2, 1, None, "h1")], kind)
    got = {(r["page"], r["key"]): r["change"] for r in I.follow_facts(old, new).collect()}
    assert got == {(1, "item:m1"): "edited", (1, "line:h2:1"): "same", (1, "line:h2:2"): "gone", (1, "item:m2"): "moved", (1, "line:h7:1"): "added", (2, "line:h1:1"): "same"}


def test_pending_rows_are_embedded_until_the_model_fails(spark):
    def embed(texts):
        if any(t == "bad" for t in texts):
            raise OSError("no model")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(12)], "id int, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in I.embed_pending(rows, embed, "id", "text", size=2).collect()}
    assert [i for i, v in got.items() if v] == [0, 1, 2, 3] and len(got) == 12
    left = rows.filter("id > 5")
    assert all(r["embedding"] == [float(r["id"])] for r in I.embed_pending(left, embed, "id", "text", size=2).collect())
    assert I.embed_pending(rows.limit(0), embed, "id", "text").count() == 0


def test_verdicts_hang_on_model_and_prompt(spark):
    cache = spark.createDataFrame(
        [("a", "m", "1", "conflict", None, "r", 1), ("a", "m", "1", "none", None, "s", 2), ("b", "m", "1", "unverified", None, None, 3), ("b", "m", "1", "conflict", None, None, 1), ("c", "m", "1", "qualified", " ", None, 1), ("d", "n", "1", "conflict", None, None, 1), ("e", "m", "1", "qualified", "by year", None, 1)],
        "fingerprint string, model string, prompt string, verdict string, qualification string, reason string, at int",
    )
    df = spark.createDataFrame([(x,) for x in "abcdef"], "fingerprint string")
    got = {r["fingerprint"]: r["verdict"] for r in I.with_verdicts(df, cache, "m", "1").collect()}
    assert got == {"a": "none", "b": None, "c": None, "d": None, "e": "qualified", "f": None}


def test_backlog_retries_and_goes_on_after_a_restart(spark, tmp_path):
    from cairn.streaming.backlog import backlog

    (tmp_path / "in").mkdir()
    calls = str(tmp_path / "calls")

    def work(key, revision):
        with open(calls, "a") as f:
            f.write(f"{key}:{revision}\n")
        with open(calls) as f:
            n = f.read().split().count(f"{key}:{revision}")
        if key == "never" or key == "later" and n < 3:
            raise OSError("no model")
        return f"made {key} {revision}"

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    asked = spark.readStream.schema("key string, revision long").json(str(tmp_path / "in"))

    def put(name, *rows):
        (tmp_path / name).write_text("".join(f'{{"key": "{k}", "revision": {r}}}\n' for k, r in rows))
        (tmp_path / name).rename(tmp_path / "in" / name)

    def run(seconds, until):
        import time

        q = backlog(asked, work, most=4, pause_ms=200).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
        end = time.time() + seconds
        try:
            while time.time() < end and not until():
                if q.exception():
                    raise q.exception()
                time.sleep(1)
        finally:
            q.stop()

    def told():
        try:
            rows = spark.read.schema("key string, revision long, tries int, outcome string").parquet(str(tmp_path / "out")).collect()
        except Exception:
            return []
        return sorted((r["key"], r["revision"], r["tries"], r["outcome"]) for r in rows)

    try:
        put("a", ("one", 1), ("one", 1), ("later", 1), ("never", 1))
        run(90, lambda: ("later", 1, 1, "failed") in told() and ("never", 1, 1, "failed") in told())
        put("b", ("one", 1), ("one", 0), ("two", 7))
        run(120, lambda: ("never", 1, 4, "given_up") in told() and ("later", 1, 3, "done") in told() and ("two", 7, 1, "done") in told())
        got = told()
        assert [x for x in got if x[0] == "one"] == [("one", 1, 1, "done")]
        assert [x for x in got if x[0] == "later"] == [("later", 1, 1, "failed"), ("later", 1, 2, "failed"), ("later", 1, 3, "done")]
        assert [x[3] for x in got if x[0] == "never"] == ["failed"] * 3 + ["given_up"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
