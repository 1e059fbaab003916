import random

import pyarrow as pa
import pytest

import corpus_pipeline as P
from graphloom.llm import common
from tests.llm.fixtures import documents, text


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    clean = [(i, text(rng, rng.randint(60, 200))) for i in range(40)]
    base = text(rng, 150)
    near = base.split()
    near[10] = "changed"
    item = text(rng, 30)
    rows = clean + [(100, base), (101, base), (102, " ".join(near)), (103, "short"), (104, "a b c " * 50), (105, f"{text(rng, 60)} {item} {text(rng, 60)}"), (106, f"{text(rng, 60)} token = {'0123456789abcdef' * 2}"), (107, None)]
    at = str(tmp_path_factory.mktemp("sf"))
    documents(spark, rows, extra=False).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, dict(rows)


def test_stages(spark, corpus):
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    after = []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, at)
        after.append({r.doc_id: r for r in docs.collect()})
    assert set(rows) - set(after[0]) == {103, 104, 107}
    assert set(after[0]) - set(after[1]) == {101, 102}
    assert set(after[1]) - set(after[2]) == {105}
    assert set(after[2]) == set(after[3]) == set(after[4])
    assert "[REDACTED]" in after[3][106].text and "abcdef" not in after[3][106].text and after[3][106].n_chars == len(after[3][106].text)
    assert after[3][0].text == rows[0]
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in after[4].values())
    for got in after[:4]:
        assert all(set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for r in got.values())


def test_run(spark, corpus):
    at, _ = corpus
    got = P.run(spark, at)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and got.count() == 42
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None


def test_empty(spark, tmp_path, corpus):
    documents(spark, [], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark, tmp_path, corpus):
    """A rejected row takes no other row of its id with it, and of a group exactly one row stays, whatever its ids."""
    rng = random.Random(21)
    clean = [(i, text(rng, 120)) for i in range(30)]
    one, two, three = (text(rng, 150) for _ in range(3))
    leak = f"{text(rng, 60)} {spark.read.parquet(f'{corpus[0]}/benchmark.parquet').first().text} {text(rng, 60)}"
    rows = clean + [(50, one), (50, one), (50, two), (50, "short"), (50, leak), (None, three), (None, three), (None, three + " more"), (60, two + " tail"), (None, "short"), (7, clean[7][1])]
    docs = documents(spark, rows, extra=False)
    stages = dict(P.STAGES)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    got = left(stages["quality rules"](spark, docs, corpus[0]))
    assert got == sorted((r for r in rows if r[1] != "short"), key=str)
    docs = documents(spark, got, extra=False)
    got = left(stages["near duplicates"](spark, docs, corpus[0]))
    assert len(got) == len(set(got)) and [r for r in got if r[0] == 50 and r[1] in (one, two)] == sorted([(50, one), (50, two)], key=str)
    assert sum(r[0] is None for r in got) == 1 and (60, two + " tail") not in got and len(got) == 30 + 4
    got = left(stages["benchmark decontamination"](spark, documents(spark, got, extra=False), corpus[0]))
    assert (50, leak) not in got and len(got) == 33


def test_arrow_batches_are_small(spark, corpus):
    """Long texts come to the workers in batches of a few MB, and ``run`` leaves the session as it was."""
    before = spark.conf.get(common.BATCH_KEY)
    try:
        docs = spark.range(0, 900, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefg ', 2000) AS text", "'en' AS lang", "'web' AS source")
        P.tokens(spark, docs, corpus[0])
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
        got = [r.n for r in sizes.collect()]
        assert sum(got) > 12 << 20 and max(got) < common.BATCH_BYTES + (1 << 16)
    finally:
        spark.conf.set(common.BATCH_KEY, before)


def test_scratch_files_follow_size(spark, corpus):
    """However many shuffle partitions there are, small tables are written in no more files than there are cores."""
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet").coalesce(1)
    before, files, real = {k: spark.conf.get(k) for k in (*held, common.BATCH_KEY)}, {}, common.write_shared

    def counted(s, df, name, *size):
        out, path = real(s, df, name, *size)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out, path

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        common.write_shared = counted
        good = P.quality_rules(spark, docs, at).localCheckpoint()
        got = {r.doc_id for r in P.near_duplicates(spark, good, at).collect()}
    finally:
        common.write_shared = real
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(rows) - got == {101, 102, 103, 104, 107}
    files["grams"].pop(0)  # the counts, of a size not known before
    cores = spark.sparkContext.defaultParallelism
    assert len(files["grams"]) > 5 and not {n: f for n, f in files.items() if n in ("grams", "hard", "again", "groups", "first") and max(f) > cores}
