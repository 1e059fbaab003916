import hashlib
import math
import zlib

from graphloom.llm import shard_tree as S
from tests.llm.fixtures import documents, odd_rows


def brute(key, tree):
    def u(node):
        return (int(hashlib.md5(f"{key}{node}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def choose(level, leaves, by):
        w = {}
        for x in leaves:
            w[by(x)] = w.get(by(x), 0) + x.weight
        return min(w, key=lambda i: (-math.log(u(f"/{level}{i}")) / w[i], i))

    r = choose("region", tree, lambda x: x.region)
    k = choose("rack", [x for x in tree if x.region == r], lambda x: x.rack)
    return choose("shard", [x for x in tree if x.region == r and x.rack == k], lambda x: x.shard)


def test_law_slots_and_brute_force(spark):
    rows = odd_rows()
    got = S.shard(documents(spark, rows), S.topology(40), S.topology(41)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.size, r.text_crc32) in texts[r.doc_id]
        assert r.shard == brute(key, S.topology(40)) and r.grown_shard == brute(key, S.topology(41))


def test_growth_moves_only_into_the_new_shard(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = S.shard(docs, S.topology(40), S.topology(41)).collect()
    by = {}
    for r in got:
        assert r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 160 and 50 < sum(r.grown_shard == 40 for r in got) < 160


def test_weights_and_empty(spark):
    tree = [S.Leaf(0, 0, 0, 3.0), S.Leaf(0, 1, 1, 1.0), S.Leaf(1, 2, 2, 4.0)]
    docs = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    n = {r["shard"]: r["count"] for r in S.shard(docs, tree).groupBy("shard").count().collect()}
    assert abs(n[0] - 1500) < 150 and abs(n[1] - 500) < 100 and abs(n[2] - 2000) < 150
    assert S.shard(docs.limit(0), tree).count() == 0


def test_one_id_with_many_rows(spark, monkeypatch):
    """Rows of one id, or of none, are spread over buckets and parts; slots stay gapless."""
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    monkeypatch.setattr(S, "PART_ROWS", 7)
    rows = [(1, f"text {i % 40}") for i in range(400)] + [(None, "same")] * 100 + [(i, "x") for i in range(50)]
    got = S.shard(documents(spark, rows), S.topology(4, 2, 1, 2), S.topology(5, 2, 1, 2)).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, len(t) + 16) for i, t in rows), key=str)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
