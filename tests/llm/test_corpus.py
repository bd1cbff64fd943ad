"""What needs the whole corpus: language model, mix, search, near-dedup, shards, dedup, packing."""

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import blocks, ctw, dartminhash, maxscore, mixing, packing, pfp, sharding
from tests.llm.helpers import by_id, frame, words


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_ctw_base(spark, sf_dir):
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        given = [(r["doc_id"], r["text"]) for r in docs.collect()]
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        count, ends = Counter(), 0
        for i, t in given:
            if not held(i):
                count.update(words(lower(t)))
                ends += 1
        n, v = sum(count.values()) + ends, len(count) + 1
        want = Counter()
        for i, t in given:
            cs = [*(count[w] for w in words(lower(t))), ends]
            want[(i, held(i), len(cs), sum(c > 0 for c in cs), n, round(sum(math.log10((c + 1) / (n + v + 1)) for c in cs), 6))] += 1
        got = ctw.score(docs, block_bytes=20_000).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] == 0 for r in got if r["n_tokens"] == 1 and r["bits_per_byte"] == 0) and all(r["score"] <= 0 for r in got)


@pytest.mark.parametrize(("depth", "together"), [(5, 256), (5, 2), (2, 256), (6, 2)])
def test_ctw_is_the_tree(spark, depth, together):
    """Against a plain recursive context tree; also when sums and answers are put together from a few blocks at a time."""
    given = [(i, t) for i, t in enumerate(["abab abra", "the cat sat on the mat", "", "the cat", "zq", "the dog sat on the rug", "é"])]
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(given, "doc_id long, text string"), block_bytes=30, depth=depth, together=together).collect()}
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def path(text):
        b = bytes(depth) + text.encode()
        for k in range(depth, len(b)):
            for s in range(8):
                yield [(b[k - d : k], (1 << s) | (b[k] >> (8 - s))) for d in range(depth + 1)], (b[k] >> (7 - s)) & 1

    for i, t in given:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for nodes, bit in path(t):
                for d, x in enumerate(nodes):
                    counts[x][bit] += 1
                    if d < depth:
                        children[x].add(nodes[d + 1])

    def own(x):
        a, b = counts.get(x, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def weighed(x):
        return own(x) if len(x[0]) == depth else float(np.logaddexp(own(x), sum(weighed(c) for c in children.get(x, ())))) - math.log(2)

    def chance(nodes, bit):
        p = None
        for x in reversed(nodes):
            a, b = counts.get(x, (0, 0))
            kt = ((b if bit else a) + 0.5) / (a + b + 1)
            w = 1.0 if p is None else math.exp(own(x) - math.log(2) - weighed(x))
            p = kt if p is None else w * kt + (1 - w) * p
        return p

    for i, t in given:
        assert got[i] == pytest.approx(sum(math.log10(chance(*x)) for x in path(t)), abs=1e-8)


def test_log_gamma():
    x = np.concatenate([np.linspace(0.5, 30, 200), [1e3, 1e6, 1e9]])
    assert ctw.log_gamma(x.copy()) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-10)


def test_mix(spark, sf_dir):
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        given = docs.collect()
        got = mixing.plan(docs).collect()
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in given)
        sizes = Counter()
        for r in given:
            sizes[r["source"]] += len(words(r["text"]))
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        total, capped = sum(sizes.values()), set()
        while True:
            level = (total - sum(3 * sizes[s] for s in capped)) / (sum(weight[s] for s in order if s not in capped) or 1)
            over = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
            if not over:
                break
            capped |= over
        target = {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
        taken, largest = Counter(), Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
            assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
        places = sorted((p, a) for r in got for p, a in zip(r["places"], r["positions"]))
        assert [p for p, _ in places] == list(range(sum(r["copies"] for r in got))) and [round(a, 9) for _, a in places] == sorted(round(a, 9) for _, a in places)
        same = lambda rows: Counter(str([r[c] for c in r.asDict() if c != "places"]) for r in rows)  # noqa: E731  equal rows may swap places
        assert same(got) == same(mixing.plan(docs.repartition(7)).collect())
        out = mixing.mix(docs)
        assert out.schema == docs.schema and out.count() == sum(r["copies"] for r in got)
        times = Counter()
        for r in got:
            times[(r["doc_id"], r["size"])] += r["copies"]
        assert Counter((r["doc_id"], len(words(r["text"]))) for r in out.collect()) == +times


def test_many_sources_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    names = [None, "", "b", "é", "a", "Z", "😀", "zz"]
    got = mixing.numbered(spark.createDataFrame([(x, 1) for x in names], "source string, source_size long")).collect()
    order = sorted(names, key=lambda x: (x is None, (x or "").encode()))
    assert {r["source"]: r["at"] for r in got} == {x: i for i, x in enumerate(order)}


def test_keep_one_is_the_same_again(spark):
    """Rows that are equal in id and text but not in other columns: the same one stays, however they are dealt."""
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, f"s{i}") for i in range(20)] + [(2, None, "x")], "doc_id long, text string, source string")
    assert {tuple(sorted(str(r) for r in dartminhash.keep_one(docs.repartition(n)).collect())) for n in (1, 3, 7)} == {tuple(sorted(str(r) for r in [docs.where("source = 's0'").first(), docs.where("source = 'x'").first()]))}


def vectors(spark, given, kind="float"):
    return spark.createDataFrame(given, f"vec_id long, embedding array<{kind}>, s int, b int, id long")


def best_of(rows):
    held = [(r["vec_id"], [math.floor(256 * Fraction(x)) for x in r["embedding"]]) for r in rows if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = Counter()
    for q, v in {(q, tuple(v)) for q, v in held if q % 50 == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w)), i, tuple(w)) for i, w in held]
        scores.remove(next(s for s in scores if s[1:] == (q, v)))
        want.update((q, k, i, -s if -(2**63) <= -s < 2**63 else None) for k, (s, i, _) in enumerate(sorted(scores)[:5], 1))
    return want


def test_maxscore(spark, sf_dir):
    rng = np.random.default_rng(1)
    given = [(i, rng.normal(0, 0.3, 16).round(2).tolist(), 1, 2, 3) for i in range(300)]
    given += [(50, given[50][1], 1, 2, 3), (400, None, 1, 2, 3), (450, [float("nan")] * 16, 1, 2, 3), (500, [None] + [0.5] * 15, 1, 2, 3), (None, [0.1] * 16, 1, 2, 3), (550, [0.0] * 16, 1, 2, 3), (600, [0.25] * 3, 1, 2, 3), (650, [], 1, 2, 3)]
    sparse = [(i, [float(x) if rng.random() < 0.2 else 0.0 for x in rng.integers(-3, 4, 16)], 1, 2, 3) for i in range(600)]
    for rows in (vectors(spark, given), vectors(spark, sparse), vectors(spark, given[:3]), vectors(spark, []), spark.read.parquet(f"{sf_dir}/embeddings.parquet")):
        assert Counter(tuple(r) for r in maxscore.top(rows).collect()) == best_of(rows.collect())


def test_maxscore_large_numbers(spark):
    """Every finite component takes part, however large; what no long holds is null in its place."""
    rng = np.random.default_rng(3)
    values = [0.0, 1.5, -2.25, 1e10, -1e10, 2.0**55, -(2.0**55), 3.0e38, 1e300, -1e300, 1.7e308, 2.0**52 + 1, 1e-300, -1e-300]
    given = [(i, [values[x] for x in rng.integers(0, len(values), 4)], 1, 2, 3) for i in range(200)] + [(i, rng.normal(0, 1, 4).tolist(), 1, 2, 3) for i in range(200, 500)]
    given += [(1000, [0.0, 2.0, 0.0, 0.0], 1, 2, 3), (1001, [2.0**55, 2.0, 0.0, 0.0], 1, 2, 3)]
    rows = vectors(spark, given, "double")
    assert Counter(tuple(r) for r in maxscore.top(rows).collect()) == best_of(rows.collect())


def test_maxscore_skips():
    """Rows that stand in no essential list aren't looked at."""
    values = np.zeros((1000, 4))
    values[:80, 0], values[:, 3] = 1000, np.arange(1000) % 3
    shard = maxscore.Shard(np.arange(1000), values)
    assert [len(x.rows) if x.rows is not None else 1000 for x in shard.up] == [80, 0, 0, 1000]
    rows, scores = shard.top(np.array([5.0, 1.0, 1.0, 1.0]), 6)
    assert rows.tolist() == [2, 5, 8, 11, 14, 17] and set(scores.tolist()) == {5002.0}


def classes_of(given):
    sets = []
    for t in (x[1] for x in given):
        w = words(lower(t))
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    group = list(range(len(given)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_near_dedup(spark, sf_dir):
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        given = [(r["doc_id"], r["text"]) for r in docs.collect()]
        group = classes_of(given)
        members = defaultdict(list)
        for (i, _), g in zip(given, group):
            members[g].append(i)
        want = Counter((i, min((x for x in members[g] if x is not None), default=None), len(members[g])) for (i, _), g in zip(given, group))
        assert Counter(tuple(r) for r in dartminhash.classes(docs).collect()) == want
        out = dartminhash.keep_one(docs)
        assert out.schema == docs.schema and out.count() == len(set(group))


def test_one_large_group(spark):
    """Copies and near copies of one text, and a text that shares half with it: pairs grow with the group, not its square."""
    base = [f"w{i}" for i in range(200)]
    given = [(i, " ".join(base[:i] + ["new"] + base[i + 1 :]) if i % 2 else " ".join(base)) for i in range(120)] + [(500, " ".join(base[:100] + [f"v{i}" for i in range(100)]))]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(120)} == {0} and got[500] == 500


def test_only_texts_that_share_a_bucket_are_shuffled(spark, monkeypatch):
    """Texts that meet no other don't go into the exchange for shingle sets; the buckets are written once."""
    base = [[f"w{k}x{i}" for i in range(60)] for k in range(200)]
    given = [(k, " ".join(w)) for k, w in enumerate(base)] + [(200 + k, " ".join([*base[k][:-1], "new"])) for k in range(5)] + [(300, None), (None, " ".join(base[9]))]
    sent, names, texts_of, written = [], Counter(), dartminhash.texts_of, dartminhash.written
    monkeypatch.setattr(dartminhash, "texts_of", lambda docs, *a: sent.append(docs.count()) or texts_of(docs, *a))
    monkeypatch.setattr(dartminhash, "written", lambda df, name: names.update([name]) or written(df, name))
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: k for k in range(200)} | {200 + k: k for k in range(5)} | {300: 300, None: 9}
    assert len(sent) == 1 and 10 <= sent[0] < 60 and names["bands"] == 1


def test_sift_lets_all_through(spark, monkeypatch):
    """Whatever the sift's size, no wanted text is left out; a null text counts as an empty one."""
    rows = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(400)], "id long, text string")
    bands = rows.where("id % 7 = 0").select(dartminhash.text_hash(rows["text"]).alias("h"))
    for most in (1, 64, 1 << 24):
        monkeypatch.setattr(dartminhash, "SIFT_MOST", most)
        got = Counter(r["id"] for r in dartminhash.sifted(rows, bands).collect())
        assert set(got.values()) == {1} and {i for i in range(400) if i % 7 == 0} <= set(got)
    assert len(got) < 150 and dartminhash.sifted(rows, bands.limit(0)).isEmpty()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    close = []
    for _ in range(20):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
        wa, wb = rng.random(300) * 3, rng.random(300) * 3
        da, db = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
        same = sum(min(da.get(x, 0), db.get(x, 0)) for x in {*da, *db}) / sum(max(da.get(x, 0), db.get(x, 0)) for x in {*da, *db})
        s = dartminhash.sketch(np.repeat([0, 1], 300), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 400)
        close.append((s[0] == s[1]).mean() - same)
    assert abs(np.mean(close)) < 0.02


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_shards(spark, sf_dir):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(k,) for k in (0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 3000))], "k long")
    assert all((r[1]["shard"], r[1]["grown"]) == (jump(r[0] % 2**64, 24), jump(r[0] % 2**64, 25)) for r in keys.select("k", sharding.jump(sharding.halves(F.col("k")), 24)).collect())
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = sharding.assign(docs).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len({r["shard"] for r in rs}) == 1 for rs in by_id(got).values())
        for i, rs in by_id(got).items():
            assert rs[0]["shard"] == jump(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16), 24)
    named = sharding.assign(frame(spark).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))).collect()
    assert len(named) == frame(spark).count() and all(0 <= r["shard"] < 24 for r in named)


def dedup_of(given):
    texts = [(t or "").encode() for _, t in given]
    count = Counter(b[p : p + 200] for b in texts for p in range(len(b) - 199))
    out = Counter()
    for (i, _), b in zip(given, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("block_bytes", "bits"), [(3000, 64), (1 << 20, 64), (3000, 6)])
def test_pfp(spark, sf_dir, block_bytes, bits):
    """bits: with 6 of them, all strings share their first hashes with others, and only the second tells them apart."""
    import random

    rng = random.Random(1)
    base = "".join(rng.choice("ab") for _ in range(3000))
    odd = [(i, base[(a := rng.randrange(2000)) : a + rng.randrange(1000)] + "".join(rng.choice("abcdé \n") for _ in range(rng.randrange(300)))) for i in range(40)]
    odd += [(101, ""), (102, "a" * 199), (103, "a" * 200), (104, "b" * 201), (105, "xy" * 500), (106, base[:200]), (107, base[1:201])]
    for docs in (frame(spark), spark.createDataFrame(odd, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        assert Counter(tuple(r) for r in pfp.dedup(docs, block_bytes=block_bytes, bits=bits).collect()) == dedup_of([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_suffix_orders():
    """The dictionary's suffixes by their bytes; a block's places in the order of their suffixes, strings of equal bytes together."""
    rng = np.random.default_rng(4)
    flat = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = np.minimum(start + rng.integers(1, 260, 300), 4000)
    held = [flat[a : min(b, a + 200)].tobytes() for a, b in zip(start, end)]
    assert pfp.ranks(flat, start, end).tolist() == [sum(y < x for y in held) for x in held]
    parts = [rng.integers(97, 123, 500).astype(np.uint8) for _ in range(6)]
    texts = [np.concatenate([parts[i] for i in rng.integers(0, 6, rng.integers(1, 8))]).tobytes() for _ in range(12)] + [b"a" * 900, b"ab" * 500, b"", b"x" * 199]
    b = object.__new__(pfp.Block)
    b.flat, b.starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    b.parse = pfp.parse(b.flat, b.starts)
    at = np.concatenate([np.arange(s, e - 199) for s, e in zip(b.starts[:-1], b.starts[1:]) if e - s >= 200])
    order, new = b.order(at)
    strings = [b.flat[i : i + 200].tobytes() for i in at[order]]
    assert strings == sorted(strings) and new.tolist() == [not k or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_blocks_of_large_tables(spark, monkeypatch):
    """Blocks and buckets over the size from which they grow; keys of other types than long."""
    monkeypatch.setattr(blocks, "LARGE", 1000)
    docs = frame(spark).where("doc_id IS NOT NULL")
    want = Counter((str(r[0]), *r[1:]) for r in pfp.dedup(docs).collect())
    assert want == dedup_of([(str(r["doc_id"]), r["text"]) for r in docs.collect()])
    scores = {str(r["doc_id"]): r["score"] for r in ctw.score(docs).collect()}
    for kind in ("string", "smallint", "decimal(10,0)"):
        typed = docs.withColumn("doc_id", docs["doc_id"].cast(kind))
        assert Counter((str(r[0]), *r[1:]) for r in pfp.dedup(typed, block_bytes=500).collect()) == want
        assert {str(r["doc_id"]): r["score"] for r in ctw.score(typed, block_bytes=500).collect()} == pytest.approx(scores)


def check_places(got):
    """Sequences without gaps or overlaps, none over the capacity; how many."""
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in ends.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    return len(ends)


def test_packing(spark, sf_dir):
    own = Tokenizer.from_file(packing.TOKENIZER)
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter()
        for r in docs.collect():
            ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids), 1024), len(ids)]
            want.update((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
        got = packing.pack(docs).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        assert check_places(got) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.02 + 1


def best_fit_decreasing(sizes, capacity):
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps[gaps.index(min(fits))] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_sweep_is_best_fit():
    """Each piece, from the longest, gets the smallest slot that holds it."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        slots, docs = rng.integers(1, 20, rng.integers(0, 15)), rng.integers(1, 20, rng.integers(0, 15))
        size, slot = np.concatenate([slots, docs]), np.arange(len(slots) + len(docs)) < len(slots)
        order = np.lexsort((~slot, -size))
        a, b = packing.matched(slot[order])
        free, want = sorted(slots.tolist()), []
        for d in sorted(docs.tolist(), reverse=True):
            if fits := [s for s in free if s >= d]:
                want.append((d, fits[0]))
                free.remove(fits[0])
        assert sorted(zip(size[order][b].tolist(), size[order][a].tolist())) == sorted(want)


def test_rounds_pack_like_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for most in (16, 64, 200, 512):
        length, gap = rng.integers(1, most + 1, 3000), rng.integers(0, 500, 200)
        where, offset = packing.place(length, gap, 1024)
        assert (where >= 0).all()
        used = defaultdict(list)
        for w, o, n in zip(where.tolist(), offset.tolist(), length.tolist()):
            used[w].append((o, n))
        for w, v in used.items():
            at = 1024 - int(gap[w]) if w < len(gap) else 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= 1024
        begun = len(set(where.tolist()) | set(range(len(gap))))
        assert begun <= best_fit_decreasing([*length.tolist(), *(1024 - int(g) for g in gap if g)], 1024) * 1.01 + 1 + (gap == 0).sum()


@pytest.mark.parametrize("sizes", ["mixed", "equal", "tiny"])
def test_rounds_over_the_cluster(spark, sizes):
    """No round in one task: the same places are filled as when all run in one."""
    rng = np.random.default_rng(5)
    length = {"mixed": rng.integers(1, 513, 400), "equal": np.full(300, 300), "tiny": rng.integers(1, 9, 600)}[sizes]
    gap = rng.integers(1, 400, 60)
    docs = spark.createDataFrame([(i, int(n)) for i, n in enumerate(length)], "item long, length long").repartition(3)
    gaps = spark.createDataFrame([(10_000 + i, int(n)) for i, n in enumerate(gap)], "sequence_id long, gap long")
    lengths = dict(enumerate(length.tolist()))
    counts = []
    for few in (0, 1 << 18):
        got = [r for x in packing.places(docs, gaps, 1024, few) for r in x.collect()]
        assert sorted(r["item"] for r in got) == list(range(len(length)))
        held = [{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": lengths[r["item"]]} for r in got]
        held += [{"sequence_id": 10_000 + i, "offset": 0, "length": 1024 - int(n)} for i, n in enumerate(gap)]
        counts.append(check_places(held))
    assert counts[0] == counts[1]


def test_long_runs_encode():
    own = Tokenizer.from_file(packing.TOKENIZER)
    given = [" " * 3000, "a" * 3000, "\n\n\t x" * 50, "!?" * 900, "<|endoftext|>", "\x00 é😀", "", "a\u00a0b\u2003c\u3000d\x1ce\x85f", "日本語  テキスト\r\n\t x", "it's we'll I'm don'T 'd", "½ ² Ⅷ ١٢ a1b2", "\U0001fae8\u1c89 x", "  a   b    ", "ǅ ʰ ª ٠"]
    rng = np.random.default_rng(6)
    for top in (128, 0x250, 0x3000, 0x11000):
        given += ["".join(chr(c) for c in rng.integers(0, top, 200) if not 0xD800 <= c < 0xE000) for _ in range(30)]
        given += ["".join(rng.choice(list(" \n\tab1'.é日")) for _ in range(80)) for _ in range(30)]
    assert [x.tolist() for x in packing.encode(given)] == [own.encode(x, add_special_tokens=False).ids for x in given]


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def encode_batch_fast(self, given, **options):
        self.texts += len(given)
        return self.own.encode_batch_fast(given, **options)


def test_tokenizer_is_asked_for_many_words_at_once(monkeypatch):
    encoder = packing.Encoder(packing.TOKENIZER)
    own, encoder.own = encoder.own, Counted(encoder.own)
    monkeypatch.setattr(packing, "_encoder", lambda path: encoder)
    rng = np.random.default_rng(7)
    given = ["".join(rng.choice(["", " ", "\n", ", "]) + "".join(rng.choice(list("abcdeéß"), 12)) for _ in range(100)) for _ in range(50)]
    assert [x.tolist() for x in packing.encode(given)] == [own.encode(x, add_special_tokens=False).ids for x in given]
    assert encoder.own.texts < 50  # some 5,000 words
    assert [x.tolist() for x in packing.encode(given[::-1])] == [own.encode(x, add_special_tokens=False).ids for x in given[::-1]]
    assert encoder.own.texts < 50


@pytest.mark.parametrize("most", [3, 40, 1000])
def test_words_are_forgotten(monkeypatch, most):
    monkeypatch.setattr(packing, "REMEMBERED", most)
    encoder = packing.Encoder(packing.TOKENIZER)
    monkeypatch.setattr(packing, "_encoder", lambda path: encoder)
    own = Tokenizer.from_file(packing.TOKENIZER)
    rng = np.random.default_rng(8)
    for _ in range(40):
        given = ["".join(rng.choice([" the", " of", "'s", "'ll", "'", " ", "\n", "\xa0", "<|endoftext|>", "x" * 70, " " + "".join(rng.choice(list("abc"), 4))], 30)) for _ in range(rng.integers(1, 5))]
        assert [x.tolist() for x in packing.encode(given)] == [own.encode(x, add_special_tokens=False).ids for x in given]


@pytest.mark.parametrize("change", ["bytes missing", "mark with a space", "mark with letters only"])
def test_other_tokenizers(tmp_path, change):
    with open(packing.TOKENIZER) as file:
        given = json.load(file)
    if change == "bytes missing":  # what has no id is left out
        given["model"] |= {"vocab": {x: i for i, x in enumerate("abcĠĊ")} | {"ab": 5}, "merges": ["a b"]}
        given["added_tokens"] = []
    else:
        given["added_tokens"][0]["content"] = {"mark with a space": "b a", "mark with letters only": "ba"}[change]
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(given))
    own = Tokenizer.from_file(str(path))
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("aabbcd \n'"), 60)) for _ in range(40)]
    assert [x.tolist() for x in packing.encode(texts, str(path))] == [own.encode(x, add_special_tokens=False).ids for x in texts]


def test_empty(spark):
    none = frame(spark, [])
    for out in (ctw.score(none), mixing.plan(none), mixing.mix(none), dartminhash.classes(none), dartminhash.keep_one(none), sharding.assign(none), pfp.dedup(none), packing.pack(none)):
        assert out.count() == 0
