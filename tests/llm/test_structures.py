"""Conversation repair, manifests and nearest neighbours against brute force."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from conftest import same_rows

from casesafety.llm import conversations, manifest, nearest, queries


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest", "op13_nearest"])
def test_against_duckdb(spark, duck, sf_dir, name):
    got = duck.execute(queries.ORACLE_SQL[name])
    ours, theirs = same_rows(queries.QUERIES[name](spark, sf_dir), got.fetchall(), [c[0] for c in got.description])
    assert ours == theirs and ours


@lru_cache
def every_repair(rows):
    """(cost, audit, repaired rows) of every way to edit ``rows`` (role, text) with at most two inserts in one place."""
    seen, marked = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        marked.append((role, text, not bare or (role, text) in seen, bool(bare) and bare[-1] not in ".!?"))
        seen.add((role, text))

    def go(at, inserted, cost, audit, out):
        if at == len(marked):
            yield cost, audit, out
        else:
            role, text, gone, cut = marked[at]
            yield from go(at + 1, 0, cost + 2, audit + "D", out)
            if not gone:
                yield from go(at + 1, 0, cost + 5 * cut, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    yield from go(at + 1, 0, cost + 1 + 5 * cut, audit + "R", [*out, (new, text)])
        if inserted < 2:
            for new in ("user", "assistant"):
                yield from go(at, inserted + 1, cost + 5, audit + "I", [*out, (new, "")])

    def fits(out):
        s = "".join(r[:1] for r, _ in out)
        s = s[1:] if s[:1] == "s" and len(s) > 1 else s
        return s == "ua" * (len(s) // 2) and len("".join(r[:1] for r, _ in out)) == len(out)

    return min(x for x in go(0, 0, 0, "", []) if fits(x[2]))


def some_conversations(n, longest, seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 1]), role, rng.choice(["Yes.", "No", " ", "", "A b? \n", "Why.", "é "])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


@pytest.mark.parametrize("longest", [None, 2])
def test_repairs_are_the_least_of_the_cheapest(spark, monkeypatch, longest):
    """With pieces of two rows every longer conversation goes through the pieces."""
    if longest:
        monkeypatch.setattr(conversations, "LONG_ROWS", longest)
    rows = some_conversations(24, 4)
    got = {r["conv_id"]: r for r in conversations.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for conv in range(24):
        mine = in_order([r for r in rows if r[0] == conv])
        cost, audit, out = every_repair(tuple(r[2:] for r in mine))
        r = got[conv]
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        turns = {t for _, t, *_ in mine if t is not None}
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        initials = [x[2][:1] for x in mine]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    assert len(got) == 24


def test_long_conversations_are_as_short_ones(spark, monkeypatch):
    rows = some_conversations(6, 90, seed=8) + [(None, None, "user", "Same.")] * 500 + [(None, None, None, None)] * 20 + [(77, 5, "user", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(tuple, conversations.report(df).collect()), key=str)
    turns = sorted(map(str, conversations.repaired_rows(conversations.repair(df)).drop("piece", "place").collect()))
    monkeypatch.setattr(conversations, "LONG_ROWS", 16)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sorted(map(tuple, conversations.report(df).collect()), key=str) == want
    assert sorted(map(str, conversations.repaired_rows(conversations.repair(df)).drop("piece", "place").collect())) == turns
    monkeypatch.setattr(conversations, "BROADCAST_LONG", 0)
    monkeypatch.setattr(conversations, "LONG_CHARS", 40)
    assert sorted(map(tuple, conversations.report(df).collect()), key=str) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_damage_and_odd_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text {c} {t}. Good!") for c in range(40) for t in range(3)] + [(500, None, None, None)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], f"{SCHEMA}, copies long, piece string")
    spoilt = conversations.damage(df)
    kept = {(r["conv_id"], r["turn"]): r for r in spoilt.collect()}
    assert {r["copies"] for r in kept.values()} == {0, 1, 2}
    assert kept[500, None]["text"] in (" ", "") and any(r["text"] and "." not in r["text"] for r in kept.values())
    out = {r["conv_id"]: r for r in conversations.report(spoilt).collect()}
    assert set(out) == {r[0] for r in rows}
    gone = spark.createDataFrame([(1, 2, "user", "x", 0)], f"{SCHEMA}, copies int")
    assert tuple(conversations.report(gone).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.report(conversations.damage(df.limit(0))).count() == 0
    big = spark.createDataFrame([(1, 0, "user", "w " * 3_000_000 + "."), (1, 1, "assistant", "Yes.")], SCHEMA)
    assert conversations.report(big).first()["audit"] == "KK"


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of ``rows`` (doc_id, source, lang, n_chars, text), by whole lists."""
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    written = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(map(written, r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            run = at // 3 * 3
            yield level[run:at], level[at + 1 : run + 3]
            at //= 3

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    mine = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in mine[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(mine[s]):
            now = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = (*r[:4], r[4].replace("\n", ""))
            folded, proof = leaf(now), []
            for before, after in [*path(trees[s], at), *path(top, k)]:
                proof += before + after
                folded = h([*before, folded, *after])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize(("rise", "step"), [(7, 12), (2, 20)])
def test_manifest_is_that_of_whole_lists(spark, monkeypatch, rise, step):
    monkeypatch.setattr(manifest, "STEP", step)
    monkeypatch.setattr(manifest, "BROADCAST_SOURCES", 100_000 if rise == 7 else 0)
    monkeypatch.setattr(manifest, "RANGE_SOURCES", 100_000 if rise == 7 else 3)
    rng = random.Random(1)
    ids = [*range(40), *range(1000, 1040), -1, -64, -65, 63, 64, 2**63 - 1, -(2**63), None, None, None, 7, 7, 7]
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "\uffff", "\U0001f600", "", None, "n"]), rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["x\ny", "", None, "line\n", "ü"])) for i in ids]
    rows += [rows[3]] * 5 + [(None, "a", None, None, None)] * 30 + [(5, "a", "en", k % 9, f"t{k % 5}\n") for k in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string").repartition(3)
    got = manifest.manifest(df, manifest.without_newlines(), rise).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)


def test_odd_manifests(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = spark.createDataFrame([], schema)
    assert manifest.manifest(empty).count() == 0
    one = manifest.manifest(spark.createDataFrame([(1, None, None, None, "a" * 3_000_000 + "\n")], schema)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    nulls = spark.createDataFrame([(None,) * 5] * 3, schema)
    assert sorted(map(tuple, manifest.manifest(nulls).collect())) == sorted(plain_manifest([(None,) * 5] * 3))


def plain_nearest(rows, query_ids, k):
    """Every distance, in the order of the components."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i in query_ids}:
        found = []
        for i, x in good:
            if i != q and len(x) == len(v):
                total = 0.0
                for a, b in zip(v, x, strict=True):
                    total += (a - b) * (a - b)
                found.append((math.sqrt(total) if math.isfinite(total) and total >= 1e-280 else math.dist(v, x), i))
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("kind", "rows", "lane"), [("float", 1024, 4), ("double", 8, 1), ("double", 5, 3)])
def test_neighbours_are_those_of_all_distances(spark, monkeypatch, kind, rows, lane):
    """Clusters, copies, near copies, vectors of other lengths and sizes, and rows that take no part."""
    for name, value in (("ROWS", rows), ("GROUP", rows), ("LANE", lane), ("MOST_LANE", lane)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(3, 6))[rng.integers(3, size=150)] + rng.choice([0, 1e-9, 0.1], size=(150, 1)) * rng.normal(size=(150, 6))
    m = m.astype(np.float32).astype(float)
    table = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, m[7].tolist()) for i in range(60)] + [(5, m[7].tolist())] * 30
    table += [(300 + i, [float(i), 1.0]) for i in range(15)] + [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None] * 3), (404, [math.nan] * 6), (None, [1.0] * 6), (405, [math.inf] * 6)]
    if kind == "double":
        table += [(500 + i, [1e200 * (i + 1)] * 6) for i in range(12)] + [(600 + i, [1e-200 * (i + 1)] * 6) for i in range(12)]
    df = spark.createDataFrame([(*r, "x") for r in table], f"vec_id long, embedding array<{kind}>, score string").repartition(3)
    vectors = nearest.whole_vectors(df, "vec_id", "embedding")
    queries_ = {r for r, _ in table if r is not None and (r % 5 == 0 or r >= 500)}
    got = nearest.nearest(vectors, vectors.where("id % 5 = 0 or id >= 500"), 10)
    assert sorted(map(tuple, got.collect())) == plain_nearest(table, queries_, 10)


def test_bounds_hold_the_distances():
    rng = np.random.default_rng(4)
    for scale in (1e-150, 1e-6, 1.0, 1e5, 1e160):
        q, x = (rng.normal(size=(n, 40)) * scale * rng.choice([1, 1e-3], size=(n, 1)) for n in (9, 30))
        low, high = nearest.bounds(nearest.coded(q), nearest.coded(x))
        true = np.array([[math.dist(a, b) for b in x] for a in q])
        assert (low <= true).all() and (true <= high).all()
    assert (np.median(high - low) < 0.1 * np.median(true)) or scale > 1e140


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [5.0])], "id long, v array<double>")
    assert [tuple(r) for r in nearest.nearest(df, df.where("id % 100 = 0"), 10).collect()] == [(0, 1, 1, math.sqrt(2))]
    assert nearest.nearest(df.limit(0), df, 3).count() == 0 and nearest.nearest(df, df.limit(0), 3).count() == 0


def test_staged_tables_go_with_their_run(spark):
    from pathlib import Path

    from casesafety.llm import common

    with common.run_folder(spark) as path:
        here = Path(path.removeprefix("file://"))
        assert conversations.report(spark.createDataFrame([(1, 0, "user", "Yes.")], SCHEMA)).count() == 1 and list(here.iterdir())
    assert not here.exists()
    assert common.staged(spark.range(3), "three").count() == 3


def test_the_pipeline_leaves_no_stage_behind(spark, sf_dir):
    from pathlib import Path

    import corpus_pipeline
    from casesafety.llm import common

    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    rows = corpus_pipeline.run(spark, sf_dir).count()
    left = [p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before]
    assert rows > 0 and sorted(left) == ["queued", "sizes", "stage-3", "targets"]
