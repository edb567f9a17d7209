import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.operators import ledger, readiness, text
from tabloom.operators.profile import profile_table


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("red", "scarlet"), ("red", "crimson"), ("big", "large"), ("été", "saison")], "word string, synonym string")


def test_detection_rules(spark):
    rows = [(i, f"Title {i}th", ["New York", "San Jose"][i % 2], f"ab-{i}", f"a longer sentence of words {i % 3}", None)
            for i in range(60)]
    df = spark.createDataFrame(rows, "k long, title string, city string, code string, prose string, none string")
    found = text.text_columns(df, text.unique_shares(profile_table(df)))
    assert {r["column"] for r in found.where("is_text").collect()} == {"prose"}
    titles = df.select("k", F.concat(F.lit("Great Title "), F.floor(F.col("k") / 2).cast("string")).alias("t")).withColumn(
        "t", F.regexp_replace("t", " Title", "Title"))
    found = text.text_columns(titles, text.unique_shares(profile_table(titles)))
    assert found.first()["is_text"]


def test_detection_over_first_rows(spark):
    df = spark.range(500).selectExpr("id AS k", "CASE WHEN id < 200 THEN 'a' ELSE 'many words stand in this text' END AS t")
    assert text.text_columns(df, {"t": 0.004}).first()["is_text"]
    assert not text.text_columns(df, {"t": 0.004}, 200, ["k"]).first()["is_text"]


def test_augmentation_keeps_everything_else(spark, lexicon):
    rows = [(1, "Red,  red\nand BIG! "), (2, None), (3, "   "), (4, "nothing here"), (5, "été red_big " * 50)]
    df = spark.createDataFrame(rows, "k long, t string")
    sent = dict(map(tuple, text.augment_text(df, ["t"], ["k"], lexicon, "high").collect()))
    again = dict(map(tuple, text.augment_text(df.repartition(3), ["t"], ["k"], lexicon, "high").collect()))
    assert sent == again and sent[2] is None and sent[3] == "   " and sent[4] == "nothing here"
    changed = sum(a != b for a, b in zip(sent[5].split(), rows[4][1].split()))
    assert 5 < changed < 60 and "scarlet" in sent[5] and "crimson" in sent[5] and "saison" in sent[5]


def test_dataset_growth_fills_rows_in_order(spark, lexicon):
    df = spark.range(10).selectExpr("id * 2 AS k", "'red big' AS t")
    grown = text.augment_dataset(df, ["t"], 10 + 25, "k", lexicon)
    counts = {r["k"]: r["count"] for r in grown.where("variant > 0").groupBy("k").count().collect()}
    assert counts == {k: 3 for k in range(0, 16, 2)} | {16: 1}
    assert text.augment_dataset(df, ["t"], 10, "k", lexicon).count() == 10


def test_dataset_growth_with_null_and_repeated_keys(spark, lexicon):
    df = spark.createDataFrame([(None, "red"), (1, "big red"), (1, "big red"), (1, "red"), (None, "red")], "k long, t string")
    for n in (6, 9, 10, 17):
        grown = text.augment_dataset(df, ["t"], n, "k", lexicon)
        assert grown.count() == n and grown.columns == ["k", "t", "variant"]


def test_anchors_keep_labels_and_spread_hot_pools(spark, monkeypatch):
    monkeypatch.setattr(text, "DRAWS_PER_ROW", 10)
    df = spark.range(40).selectExpr("id AS k", "CASE WHEN id = 0 THEN 'rare' ELSE 'common' END AS label", "id * 10 AS v")
    rows = text.anchored_rows(df, 0, ["k"], "label", {"rare": 200, "common": 50, "unseen": 30}, 1).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(280))
    assert all(r["label"] == "rare" for r in rows if r["row_id"] < 200)
    assert all(r["label"] == "common" for r in rows if 200 <= r["row_id"] < 250)
    assert all(r["v"] == r["k"] * 10 for r in rows)


def test_augmentation_by_join_gives_the_same_rows(spark, lexicon):
    rows = [(1, "Red,  red\nand BIG! ", "big"), (2, None, "red red"), (3, "   ", None), (4, "", "x"), (5, "été red_big ÉTÉ " * 50, "3 big 4 big"), (5, "red", ""), (None, "-red big", "red")]
    df = spark.createDataFrame(rows, "k long, t string, u string").withColumn("more", F.create_map(F.lit("a"), F.array("k")))
    place = lambda d: sorted(map(repr, d.collect()))
    here, joined = (text.augment_text(df, ["t", "u"], ["k"], lexicon, "high", table_bytes=n) for n in (text.TABLE_BYTES, 0))
    assert here.schema == joined.schema == df.schema and place(here) == place(joined) != place(df)
    none = text.augment_text(df, ["t"], ["k"], lexicon.limit(0))
    assert place(none) == place(df)


def test_anchors_for_labels_in_a_table(spark):
    df = spark.range(600).selectExpr("id AS k", "concat('l', id % 150) AS label", "id * 10 AS v")
    wanted = spark.range(160).selectExpr("concat('l', id) AS value", "1 + id % 3 AS rows")
    rows = text.anchored_rows(df, 0, ["k"], "label", wanted).collect()
    asked = {r["value"]: r["rows"] for r in wanted.collect()}
    assert sorted(r["row_id"] for r in rows) == list(range(sum(asked.values())))
    at, label_of = 0, {}
    for v in sorted(asked):
        label_of |= dict.fromkeys(range(at, at + asked[v]), v)
        at += asked[v]
    assert all(r["label"] == label_of[r["row_id"]] for r in rows if int(label_of[r["row_id"]][1:]) < 150)
    assert all(r["v"] == r["k"] * 10 for r in rows)


def test_quality_of_unchanged_text(spark):
    df = spark.createDataFrame([("a b c",), ("d",)], "t string")
    row = text.text_quality(df, df, ["t"]).first()
    assert row["length_preservation"] == 100.0 and row["vocabulary_diversity"] == 0.0 and row["score"] == 60.0


def test_contacts(spark):
    batch = spark.createDataFrame([(1, " A@b.co ", " x "), (2, "a@B.co", ""), (3, "bad", "y"), (4, None, "z"), (5, None, "z"),
                                   (6, "old@b.co", "w")], "k long, email string, interest string")
    known = spark.createDataFrame([("old@b.co",)], "email string")
    rows = {r["k"]: r for r in ledger.new_contacts(batch, known, ["k"]).collect()}
    assert {k: r["already"] for k, r in rows.items()} == {1: False, 2: True, 4: False, 5: False, 6: True}
    assert rows[1]["email"] == "a@b.co" and rows[1]["interest"] == "x"


def test_target_choice():
    class Table:
        columns = ["a", "Label", "b"]

    assert readiness.pick_target(Table, {"a": 2}) == "Label"
    assert readiness.pick_target(Table, {}, "b") == "b" and readiness.pick_target(Table, {}, "zz") is None
    Table.columns = ["a", "b"]
    assert readiness.pick_target(Table, {"b": 2}) == "b" and readiness.pick_target(Table, {}) is None


def test_readiness_reasons(spark):
    df = spark.createDataFrame([(i, "x", i % 2) for i in range(30)], "k long, s string, y int")
    def reason(real, synth, target, **more):
        return readiness.tstr(real, synth, target, ["k"], **more).first()["reason"]
    assert "no target" in reason(df, df, None)
    assert "no numeric" in reason(df, df, "y")
    assert "lacks" in reason(df, df.drop("y"), "y")
    assert "single class" in reason(df.withColumn("y", F.lit(1)).withColumn("n", F.col("k")), df.withColumn("n", F.col("k")).withColumn("y", F.lit(1)), "y")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    place = str(tmp_path / "contacts")
    day = lambda *rows: spark.createDataFrame([(k, e, "x") for k, e in rows], "k int, email string, interest string")
    first, second = day((1, "a@b.co"), (2, "A@b.co "), (3, None), (4, "no address")), day((5, "a@b.co"), (6, "c@d.co"))
    assert ledger.committed(spark, place, first.schema).isEmpty()
    marks = ledger.append_contacts(first, place, "one", ["k"])
    assert {r["k"]: r["already"] for r in marks.collect()} == {1: False, 2: True, 3: False}
    ledger.append_contacts(second, place, "two", ["k"])
    held = {(1, "a@b.co", "one"), (3, None, "one"), (6, "c@d.co", "two")}
    for again, name in ((first, "one"), (second, "two"), (first, "one")):
        ledger.append_contacts(again, place, name, ["k"])
        assert {(r["k"], r["email"], r["batch"]) for r in ledger.committed(spark, place, first.schema).collect()} == held
    ledger.append_contacts(day(), place, "three", ["k"])
    assert ledger.committed(spark, place, first.schema).count() == 3


def test_batch_names(spark, tmp_path):
    with pytest.raises(ValueError):
        ledger.commit(spark.range(1), str(tmp_path), "a/b")
    ledger.commit(spark.range(3), str(tmp_path / "t"), "007")
    assert {r["batch"] for r in ledger.committed(spark, str(tmp_path / "t"), "id long").collect()} == {"007"}


def test_texts_leave_a_task_in_blocks(monkeypatch):
    monkeypatch.setattr(text, "BLOCK_BYTES", 20)
    known = type("Known", (), {"value": {"red": ["scarlet"], "été": ["saison"]}})
    task = text.SwapTask(["k", "t"], ["t"], known, 1.0, 42)
    pieces = [["Red", " ", "big", "  "], None, [], ["- ", "été", "\n", "RED"], ["x"] * 1]
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "_key0": ["t"] * 6, "_parts0": pa.array([["skipped"], *pieces], pa.list_(pa.string())),
                                        "_first0": pa.array([0, 0, None, 1, 1, 0], pa.int32())}).slice(1)
    out = list(task([batch]))
    assert [r["t"] for b in out for r in b.to_pylist()] == ["scarlet big  ", None, "", "- saison\nscarlet", "x"]
    assert [r["k"] for b in out for r in b.to_pylist()] == [1, 2, 3, 4, 5] and len(out) > 1


def test_forests_learn_from_cells_instead_of_rows(spark):
    rows = spark.range(6000).selectExpr("CAST(id % 6 AS DOUBLE) AS f0", "CAST(id AS DOUBLE) AS f1", "CAST((id % 6) > 2 AS DOUBLE) AS label")
    cuts = readiness.bin_cuts(rows, ["f0", "f1"])
    assert cuts[0] == [0.5, 1.5, 2.5, 3.5, 4.5] and len(cuts[1]) == 31
    for regression in (False, True):
        found = readiness.cells(rows, cuts, regression).collect()
        assert len(found) == 6 * 32 and sum(r["n"] for r in found) == 6000
        assert all(r["label"] == float(r["features"][0] > 2) and r["spread"] == 0.0 for r in found)
    spread = readiness.cells(rows.withColumn("label", F.col("f1")), [[], []], True).collect()
    assert [r["n"] for r in spread] == [6000] and abs(spread[0]["spread"] - 6000 * (6000**2 - 1) / 12) < 1


@pytest.mark.parametrize("regression", [False, True])
def test_forests_on_cells_score_as_on_rows(spark, monkeypatch, regression):
    rows = spark.range(3000).selectExpr("id AS k", "CAST(id * 7919 % 1000 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS z").selectExpr(
        "*", "2 * x + 100 * z AS y" if regression else "CAST(x + 100 * z > 700 AS INT) AS y")
    score = lambda: readiness.tstr(rows, rows.where("k % 2 = 0"), "y", ["k"], regression, trees=10, depth=5).first()
    whole = score()
    monkeypatch.setattr(readiness, "ROW_BUDGET", 0)
    binned = score()
    assert binned["available"] and binned["majority_rate"] == whole["majority_rate"]
    assert all(abs(binned[c] - whole[c]) < 4 and binned[c] > 85 for c in ("real_score", "synth_score"))
