"""Each operator against brute force on planted rows: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import chunks, ctw, html_crf, line_dedup, mixing, near_dedup, packing, quality, syncmers, warc

WORDS = "the of and river stone light water green paper house wind small round north table glass".split()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, _key string, position string, n_lines string, kept string, _id string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def some(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ing", "er" + rng.choice("abcdef"))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    line = "This LINE is found in many documents of the set"
    base = some(rng, 400)
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "Héllo wörld <b>&|%</b> <|endoftext|>"), (5, "日本語のテキスト" * 50), (6, "word " * 60), (7, "a\n\n\nb\r\n" + line)]
    out += [(8, some(rng, 6000)), (9, line + "  \n" + some(rng, 30)), (10, "\t" + line.upper() + "\n" + some(rng, 30) + "\n" + line), (11, base), (12, base)]
    for i in range(13, 25):
        w = base.split()
        for _ in range(3 * (i - 12)):
            w[rng.randrange(len(w))] = "zz" + str(rng.randrange(99))
        out.append((i, " ".join(w)))
    out += [(i, some(rng, rng.randint(1, 200)) + "\n" + some(rng, 8)) for i in range(30, 60)]
    return [(d, t, None if d % 7 == 0 else f"s{d % 4}") for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "k", "i") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, rows, empty):
    held = defaultdict(set)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for d, t, _ in rows:
        for s in (t or "").split("\n"):
            held[key(s)].add(d)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(out) == len(rows) and out[10]["n_dropped"] == 0 and out[9]["n_dropped"] == 1
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [s for s in lines if not (len(key(s)) >= 20 and len(held[key(s)]) >= 3 and max(held[key(s)]) != d)]
        assert (out[d]["n_lines"], out[d]["n_dropped"]) == (len(lines), len(lines) - len(keep))
        assert (out[d]["text"] or "") == "\n".join(keep)
        assert out[d]["kept"] == "k"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_repeated_rows_are_one_document(spark):
    line = "a line that is long enough to count"
    d = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert [r["n_dropped"] for r in line_dedup.dedup_lines(d).collect()] == [0, 0, 0]


def test_packing_is_a_round_trip(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    all_ = packing.pack(docs, with_ids=True).collect()
    for r in all_:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
        got[r["doc_id"]].append((r["start"], r["ids"], r["ids_crc32"]))
    assert sorted(r["sequence_id"] for r in all_) == list(range(len(all_)))
    for d, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert [i for _, part, _ in sorted(got[d]) for i in part] == ids, d
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for _, p, c in got[d])
    assert packing.pack(empty).count() == 0


def test_packing_in_many_blocks_and_in_a_given_order(spark, monkeypatch):
    rng = random.Random(41)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, some(rng, rng.randint(0, 40)), rng.randrange(10**6)) for i in range(300)] + [(5, "twice", 1), (5, "twice", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, place long")
    whole = sorted(map(tuple, packing.pack(d).drop("offset").collect()), key=str)
    monkeypatch.setattr(packing, "BLOCK_PIECES", 40)
    assert sorted(map(tuple, packing.pack(d).drop("offset").collect()), key=str) == whole
    out = sorted(packing.pack(d, order=F.col("place")).collect(), key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in out] == list(range(len(out))) and [r["length"] for r in out] == sorted((r["length"] for r in out), reverse=True)
    pieces = packing.pieces(d, order=F.col("place")).select("doc_id", "start", "ids_crc32", "at").collect()
    at = {(r["doc_id"], r["start"], r["ids_crc32"], r["at"]) for r in pieces}
    for size in {r["length"] for r in out}:
        got = [(r["doc_id"], r["start"], r["ids_crc32"]) for r in out if r["length"] == size]
        ways = [{a for (*k, a) in at if tuple(k) == g} for g in got]
        last = -1
        for w in ways:  # some choice of places never falls
            last = min((a for a in w if a >= last), default=None)
            assert last is not None


def test_cuts():
    for n in (1, 2, 5, 2047, 2048, 2049, 10_000):
        c = list(packing.cuts(n))
        assert sum(s for _, s in c) == n and [a for a, _ in c] == list(np.cumsum([0] + [s for _, s in c])[:-1])


def fair_shares(sizes, weights, total, most=2):
    """Words to take of each source: by weight, none above `most` times its size, the excess reshared."""
    out = {s: 0.0 for s in sizes}
    left, open_ = total, {s for s in sizes if sizes[s] > 0}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left, open_ = left - sum(out[s] for s in full), open_ - full
    return out


def by_code_point(sources):
    return sorted(sources, key=lambda s: (s is None, s or ""))


def test_mixing(docs, rows, empty, spark):
    out = mixing.plan(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = fair_shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(by_code_point(sizes))}, 1.5 * sum(sizes.values()))
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 2 and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
    assert len(out) == len(rows)
    for s, part in by.items():
        taken = sum(r["size"] * r["copies"] for r in part)
        assert math.isclose(part[0]["target"], want[s]) and part[0]["source_size"] == sizes[s] and abs(taken - want[s]) <= max(r["size"] for r in part)
    mixed = mixing.mix(docs).collect()
    assert [r["position"] for r in mixed] == sorted(p for r in out for p in r["positions"])
    assert Counter(r["doc_id"] for r in mixed) == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})
    assert sorted(map(str, out)) == sorted(map(str, mixing.plan(docs).collect()))
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_follows_its_schedules(docs, rows):
    """Positions by brute force: the words before a document's middle, run through the schedule."""
    every, at = mixing.plan(docs).collect(), defaultdict(list)
    for r in every:
        at[r["source"]] += [(p, r["size"]) for p in r["positions"]]
    for i, s in enumerate(by_code_point(at)):
        first, last = mixing.SCHEDULES[[*by_code_point({r["source"] for r in every})].index(s) % 3]
        target = next(r["target"] for r in every if r["source"] == s)
        done = 0
        for p, size in sorted(at[s]):
            share = (first * p + (last - first) * p * p / 2) / ((first + last) / 2)
            assert math.isclose(share * target, done + size / 2, abs_tol=max(z for _, z in at[s]) + 1), (i, s)
            done += size


def test_mixing_takes_equal_rows_one_by_one(spark, monkeypatch):
    rows = [(1, "a b c d", "s", i % 3) for i in range(1000)] + [(2, " ".join(["x"] * 2000), "t", 0), (None, "p q", "t", 1), (None, "p q", "t", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    want = fair_shares({"s": 4000, "t": 2004}, {"s": 5, "t": 2}, 1.5 * 6004)
    for equal in (4096, 64):
        monkeypatch.setattr(mixing, "EQUAL_ROWS", equal)
        out = mixing.plan(d).collect()
        assert len(out) == 1003 and abs(sum(r["size"] * r["copies"] for r in out if r["source"] == "s") - want["s"]) <= 4
        assert max(r["copies"] for r in out) <= 2
        mixed = mixing.mix(d)
        assert mixed.columns == ["doc_id", "text", "source", "position"]
        assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(dict(sum((Counter({r["doc_id"]: r["copies"]}) for r in out), Counter())))


def test_targets_stop_at_twice_a_source(spark):
    for sizes in ({"a": 10, "b": 100, "c": 0}, {"a": 1, "b": 2, "c": 3, "d": 400, None: 7}, {f"s{i:03}": (i * i) % 97 for i in range(60)}, {"a": 0}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, words long")).collect()}
        want = fair_shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(by_code_point(sizes))}, 1.5 * sum(sizes.values()))
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in want)


def test_quality_counts(docs, rows, empty):
    for r in quality.counts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        w, lines = words(r["text"]), [s for s in (r["text"] or "").split("\n") if words(s)]
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), r["doc_id"]
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
    assert quality.judged(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(3)
    clean = [(i, " ".join(some(rng, 9).capitalize() + "." for _ in range(12))) for i in range(200)]
    junk = [(1000 + i, " ".join(x + rng.choice(("###", "&&&", "$$$")) for x in some(rng, 80).split())) for i in range(20)]
    d = spark.createDataFrame(clean + junk, "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep_good(d).collect()}
    assert kept == {i for i, _ in clean}


def symbols(t):
    return [x for w in words(t) for x in ([w] if len(w) <= 32 else w)]


def brute_anchors(t, h, k=syncmers.K, s=syncmers.S):
    """Places of the closed syncmers among the symbols, by the rule; h: the hash of a run."""
    w = symbols(t)
    inner = [h(tuple(w[i : i + s])) for i in range(len(w) - s + 1)]
    if len(w) < k:
        return [0] * bool(w)
    least = [min(inner[i : i + k - s + 1]) for i in range(len(w) - k + 1)]
    out = [i for i, x in enumerate(least) if x in (inner[i], inner[i + k - s])]
    return out or [min(range(len(least)), key=lambda i: (least[i], i))]


def unpacked(fp):
    """(anchor, place) of each long."""
    return [(x >> 32, x & 0xFFFFFFFF) for x in fp]


def brute_likeness(a, b):
    """a, b: (anchor, place) lists."""
    first = lambda f: {h: p for h, p in sorted(f, reverse=True)}
    x, y = first(a), first(b)
    both = sorted((x[h], y[h]) for h in x.keys() & y.keys())
    good = sum(len(both) == 1 or (i > 0 and both[i - 1][1] < q) or (i + 1 < len(both) and both[i + 1][1] > q) for i, (_, q) in enumerate(both))
    return good / len(x.keys() | y.keys()) if x or y else 1.0


def test_syncmers_by_brute_force(docs, rows, empty, spark):
    texts = [(d, t) for d, t, _ in rows] + [(100, "x" * 70), (101, "a b c d e f g"), (102, "a b c d e f")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    fp = {r["doc_id"]: r["fp"] for r in syncmers.fingerprint(d, "text", "fp").collect()}
    runs = sorted({tuple(symbols(t)[i : i + 2]) for _, t in texts for i in range(len(symbols(t)) - 1)})
    hashed = spark.createDataFrame(runs, "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h"))
    h = {(r["a"], r["b"]): r["h"] for r in hashed.collect()}
    for i, t in texts:
        places = [p for _, p in unpacked(fp[i])]
        assert places == brute_anchors(t, h.get), i
        assert not (len(symbols(t)) >= 7 and max(np.diff(places), default=0) > syncmers.K - syncmers.S)  # the window guarantee
    assert fp[0] == fp[1] == fp[2] == [] and fp[11] == fp[12]
    of = lambda i: {h for h, _ in unpacked(fp[i])}
    assert len(of(11) & of(13)) > 0.7 * len(of(11))
    assert syncmers.fingerprint(empty, "text", "fp").count() == 0


def test_likeness_matches_by_position(spark):
    rng = random.Random(8)
    lists = [[(rng.randrange(30) - 15, p) for p in sorted(rng.sample(range(99), rng.randrange(20)))] for _ in range(60)] + [[], [], [(1, 2)], [(1, 5)], [(1, 0), (2, 1)], [(2, 0), (1, 1)]]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(lists, lists[1:] + lists[:1], strict=True))] + [(1000, lists[0], lists[0])]
    packed = [(i, *([h << 32 | p for h, p in x] for x in (a, b))) for i, a, b in pairs]
    d = syncmers.with_likeness(spark.createDataFrame(packed, "i long, a array<long>, b array<long>"), "a", "b", "near")
    assert d.columns == ["i", "a", "b", "near"]
    got = {r["i"]: r["near"] for r in d.collect()}
    assert all(math.isclose(got[i], brute_likeness(a, b)) for i, a, b in pairs) and got[1000] == 1.0


def test_edited_texts_by_brute_force(spark, rows, empty):
    rng = random.Random(13)
    table = [(d, t or "") for d, t, _ in rows] + [(None, "nobody's text here"), (None, "another text of nobody"), (11, "shares an id")] + [(40, "the same again and again")] * 300 + [(41, f"one id, many texts {i}") for i in range(300)]
    rng.shuffle(table)
    d = spark.createDataFrame(table, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    tie = {(r["doc_id"], r["text"]): r["tie"] for r in d.collect()}
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r]))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[i, len(t), t[: len(t) - half] + n[:half]] += 1
    one = None
    for chars in (1 << 25, 2000, 300):
        got = syncmers.edited_and_next(d, chars).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want, chars
        rest = sorted((str(r["doc_id"]), r["edited"], r["near_edited"], r["near_next"], str(r["fp"]), str(r["edited_fp"])) for r in got)
        one = one or rest
        assert rest == one
    for r in got:
        assert math.isclose(r["near_edited"], brute_likeness(unpacked(r["fp"]), unpacked(r["edited_fp"])))
    assert syncmers.edited_and_next(empty.select("doc_id", "text", F.xxhash64("text").alias("tie"))).count() == 0


def test_blocks_by_many_bounds(spark):
    from sightline.llm.common import block_of

    bounds = sorted(random.Random(2).sample(range(-5000, 5000), 700))
    for n in (1, 3, 255, 256, 257, 700):
        got = spark.range(-5100, 5100, 7).select("id", block_of(F.col("id"), bounds[:n]).alias("b")).collect()
        assert all(r["b"] == sum(x < r["id"] for x in bounds[:n]) for r in got)


def brute_groups(rows, percent=85):
    sets, up = {}, {}
    for d, t, _ in rows:
        w = words((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        up[d] = d

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_groups(docs, rows, empty):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs).collect()}
    assert out == brute_groups(rows)
    assert out[13][1] == 11 and out[0] == (0, 0)
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect())
    assert kept == sorted(d for d, (_, c) in out.items() if d == c)
    assert near_dedup.near_groups(empty).count() == 0


def test_pipeline_links_from_80_percent(spark):
    import corpus_pipeline

    w = [f"w{i}" for i in range(204)]  # 200 shingles; k new words at the end change k of them
    rows = [(i, " ".join([*w[: 204 - k], *(f"x{i}-{j}" for j in range(k))]), "s") for i, k in enumerate((0, 18, 20, 22, 23, 40))]
    want = brute_groups(rows, 80)
    assert [c for _, c in want.values()] == [0, 0, 0, 0, 4, 5]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, d, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 4, 5]
    j = 0.8**near_dedup.ROWS
    assert (1 - j) ** near_dedup.BANDS < 1e-6


def test_near_groups_with_null_ids(spark):
    rng = random.Random(21)
    a, b, c = some(rng, 200), some(rng, 200), some(rng, 200)
    rows = [(5, a), (None, a), (7, a), (None, a + " more"), (None, b), (9, b + " more"), (None, c), (None, c + " more"), (1, some(rng, 50)), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(d).collect())
    size = lambda t: len({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)})
    name = [5, 5, 5, 5, 9, 9, None, None, 1, None]
    assert got == Counter((i, size(t), n, i == n) for (i, t), n in zip(rows, name, strict=True))
    kept = Counter(map(tuple, near_dedup.keep_one(d).collect()))
    of_c = [k for k in kept if k in rows[6:8]]
    assert len(of_c) == 1 and kept == Counter([(5, a), (9, b + " more"), *of_c, *rows[8:]])


def test_near_groups_with_shared_ids_and_repeated_rows(spark):
    rng = random.Random(22)
    a, b, c, e = (some(rng, 200) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " more", "x"), (3, b + " more", "x"), (4, c, "q"), (4, c, "p"), (4, c, "q"), (None, e, "x"), (None, e, "x"), (6, c + " end", "x"), (7, "", "x"), (7, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(d).collect())
    assert got == Counter([(1, 1, True)] * 2 + [(2, 1, False), (3, 1, False)] + [(4, 4, True)] * 3 + [(None, None, True)] * 2 + [(6, 4, False)] + [(7, 7, True)] * 2)
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.keep_one(d).collect())
    assert kept == Counter([(1, a), (1, b), (4, c), (None, e), (7, ""), (7, "")])


def test_links_by_brute_force_with_ids_in_disorder(spark):
    rng = random.Random(23)
    rows, n = [], 0
    for _ in range(12):
        base = some(rng, rng.choice((4, 30, 120, 400))).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"q{rng.randrange(9)}"
            rows.append((n := n + 1, " ".join(w), "s"))
    ids = list(range(-20, -20 + len(rows)))
    rng.shuffle(ids)
    rows = [(i, t, s) for i, (_, t, s) in zip(ids, rows, strict=True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for percent in (80, 85):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(d, percent).collect()} == brute_groups(rows, percent)


def test_links_in_small_blocks_and_through_hubs(spark, monkeypatch):
    """Hot buckets: many classes near each other, some only through others; blocks of a few classes."""
    rng = random.Random(24)
    base, rows = some(rng, 300).split(), []
    for i in range(90):  # most are near the base, some near another one, chains reach out step by step
        w = list(base) if i < 50 else list(rows[-1][1].split()) if i < 70 else some(rng, 300).split() if i in (70, 80) else list(rows[70 if i < 80 else 80][1].split())
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(999)}"
        rows.append((i, " ".join(w), "s"))
    rng.shuffle(rows)
    rows = [(1000 - k, t, s) for k, (_, t, s) in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {p: brute_groups(rows, p) for p in (80, 85, 93)}
    assert len({c for _, c in want[93].values()}) > 5
    for block, items in ((512, 2_000_000), (4, 2_000_000), (7, 900)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_ITEMS", items)
        for p in want if block == 4 else (85,):
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(d, p).collect()} == want[p], (block, p)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    x, y = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.merged(x, y) == near_dedup.registers(np.union1d(a, b))).all()
    j = 450 / 550
    assert abs((x == y).mean() - j) < 0.15
    far = near_dedup.registers(rng.integers(0, 2**63, 500, dtype=np.uint64))
    low = near_dedup.evidence([(x > far).sum()], [(x < far).sum()], [0.5], 0.85)
    near = near_dedup.evidence([(x > y).sum()], [(x < y).sum()], [0.5], 0.8)
    assert low[0] > near_dedup.EVIDENCE > near[0]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (98, 100), (7, 7)], "x long, y long")
    got = {r["id"]: r["root"] for r in near_dedup.components(e).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and got[99] == got[100] == 98


def test_chunks_resist_shifts(spark, empty):
    rng = random.Random(9)
    shared = some(rng, 60)
    d = spark.createDataFrame([(1, some(rng, 80) + " " + shared), (2, "x" + some(rng, 33) + " " + shared + some(rng, 20)), (3, some(rng, 300)), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunks.spans(d).collect()}
    assert set(got) == {1, 2} and got[2]["removable"] == got[2]["length"] and got[1]["removable"] == 0 and got[2]["first_doc_id"] == 1
    cut = {r["doc_id"]: r["text"] for r in chunks.cut_repeats(d).collect()}
    assert len(cut) == 5 and cut[4] is None and shared not in cut[2] and shared in cut[1]
    assert chunks.spans(empty).count() == 0 and chunks.cut_repeats(empty).count() == 0


def test_passages_over_50_words_are_found_to_their_ends(spark):
    rng = random.Random(11)
    docs, want = [], {}
    for k in range(150):
        p = " ".join(["la"] * 51) if k == 7 else some(rng, 51)
        for d in (2 * k, 2 * k + 1):
            head = some(rng, rng.randint(5, 40)) + f" {'ab'[d % 2]}< "
            docs.append((d, f"{head}{p} >{'ab'[d % 2]} {some(rng, 30)}"))
            want[d] = (len(head) - 2, len(p) + 4, 2 * k)  # the marks differ, "< " and " >" do not
    got = defaultdict(list)
    for r in chunks.spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["first_doc_id"]))
    assert all(len(got[d]) == 1 and got[d][0][1] >= 140 for d in (14, 15))  # one word again and again: ends may be a few words short
    assert {d: s for d, s in got.items() if d not in (14, 15)} == {d: [w] for d, w in want.items() if d not in (14, 15)}


def test_cut_repeats_beside_repeats_of_its_own(spark):
    rng = random.Random(12)
    p, left, right = some(rng, 60), some(rng, 60), some(rng, 60)
    whole = f"{left} | {p} | {right}"
    d = spark.createDataFrame([(1, f"{some(rng, 30)} < {p} > {some(rng, 30)}"), (2, whole), (3, whole), (4, some(rng, 90))], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in chunks.cut_repeats(d).collect()}
    before = {r["doc_id"]: r["text"] for r in d.collect()}
    assert cut[1] == before[1] and cut[4] == before[4] and cut[3] == ""
    assert cut[2] == f"{left} || {right}"


def test_chunk_ends_are_whole():
    data = random.Random(1).randbytes(5000) + b"a" * 5000
    e = chunks.ends(data)
    assert e[-1] == len(data) and all(0 < b - a <= chunks.MOST for a, b in zip([0, *e], e, strict=False)) and chunks.ends(b"") == []


def test_ctw_base_and_probability(docs, rows, empty):
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    c = Counter(w for _, t, _ in train for w in [*words((t or "").translate(LOW)), ""])
    n, v = sum(c.values()), len(c)
    model = ctw.Model(docs.where(~ctw.held_out()), depth=3)
    assert (model.tokens, model.distinct) == (n, v)
    one = {r["doc_id"]: r for r in model.score(docs).collect()}
    for d, t, _ in rows:
        w = [*words((t or "").translate(LOW)), ""]
        assert (one[d]["n_tokens"], one[d]["n_known"]) == (len(w), sum(x in c for x in w))
        assert math.isclose(one[d]["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert one[d]["score"] <= 0
        assert one[d]["n_bytes"] == len((t or "").encode()) and (one[d]["bits_per_byte"] is None) == (not t)
    assert ctw.Model(empty).score(docs).count() == len(rows) and model.score(empty).count() == 0
    assert {round(r["score"] / r["n_tokens"], 6) for r in ctw.Model(empty).score(docs.where("text IS NULL OR text = ''")).collect()} == {round(math.log10(0.5), 6)}


def naive_ctw(train, text, depth):
    """log10 probability of text by the definition: recursion over contexts, decision by decision."""
    seen = defaultdict(Counter)

    def decisions(symbol):
        bits = [symbol >> 8 & 1] if symbol == 256 else [0, *(symbol >> i & 1 for i in range(7, -1, -1))]
        return [((i, tuple(bits[:i])), b) for i, b in enumerate(bits)]

    def symbols(t):
        data = b"\n" * depth + bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c for c in t.encode())
        return [(data[i - depth : i], data[i] if i < len(data) else 256) for i in range(depth, len(data) + 1)]

    for t in train:
        for context, s in symbols(t):
            for key, bit in decisions(s):
                for d in range(depth + 1):
                    seen[key, context[depth - d :]][bit] += 1
    children = defaultdict(set)
    for key, context in seen:
        if context:
            children[key, context[1:]].add((key, context))

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    memo = {}

    def log_w(node):
        if node not in memo:
            own = kt(seen[node][0], seen[node][1])
            memo[node] = own if len(node[1]) == depth else np.logaddexp(own, sum(log_w(c) for c in children[node])) - math.log(2)
        return memo[node]

    total = 0.0
    for context, s in symbols(text):
        for key, bit in decisions(s):
            p = None
            for d in range(depth, -1, -1):
                node = (key, context[depth - d :])
                n = seen[node] if node in seen else Counter()
                if not n:
                    p = 0.5
                    continue
                est = (n[bit] + 0.5) / (n[0] + n[1] + 1)
                share = 1.0 if d == depth else math.exp(kt(n[0], n[1]) - math.log(2) - log_w(node))
                p = share * est + (1 - share) * p if d < depth else est
            total += math.log10(p)
    return total


def test_ctw_scores_by_definition_however_the_model_is_dealt(spark, monkeypatch):
    rng = random.Random(31)
    train = [some(rng, rng.randint(3, 25)) for _ in range(12)] + ["", "Ünï ABC", "aaaa aaaa"]
    texts = [*train[:4], some(rng, 12), "quite unlike ß anything", "", None, "e " * 40]
    fit = spark.createDataFrame([(t,) for t in train], "text string")
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    want = {d: {i: naive_ctw(train, t or "", d) for i, t in enumerate(texts)} for d in (2, 4)}
    for depth, often, split, held, asked, chunk in ((4, 1 << 19, 512, 2_000_000, 10**7, 1 << 26), (4, 0, 512, 50, 30, 100), (4, 20, 60, 64, 10**7, 300), (2, 5, 60, 40, 20, 1 << 26)):
        for k, v in (("HELD", held), ("ASKED", asked), ("CHUNK", chunk), ("GULP", 60 if chunk < 1000 else 3 << 20)):
            monkeypatch.setattr(ctw, k, v)
        model = ctw.Model(fit, depth, often, split)
        if split == 6 and depth > 2:
            model.hot or pytest.fail("no part was split")
        got = {r["doc_id"]: r["score"] for r in model.score(d).collect()}
        assert got.keys() == want[depth].keys() and all(math.isclose(got[i], want[depth][i], rel_tol=1e-5, abs_tol=1e-6) for i in got), (depth, often, split)


def test_long_texts_are_read_in_parts():
    rng = random.Random(6)
    for text in (some(rng, 400).encode(), b"x" * 500 + b" y " + b"z" * 700, b"a b " * 60, b"word" * 50, b" " * 300):
        for depth, size in ((5, 64), (3, 7), (2, 10**6)):
            whole, _, raw = ctw._runs([text], depth)
            got, words_, n = [], [], 0
            for texts, before, ends in ctw._parts([text], depth, size):
                codes, starts, part = ctw._runs(texts, depth, before, ends)
                got.append(codes)
                words_.append(ctw.word_numbers(part)[0])
                n += len(texts[0])
                assert starts.tolist() == [0] and (len(texts[0]) <= size or b" " not in texts[0][:-1])
            assert n == len(text) and (np.concatenate(got) == whole).all() and (np.concatenate(words_) == ctw.word_numbers(raw)[0]).all()


def test_parts_are_gathered_whole(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((p + (ctw._SPLIT if p % 3 == 0 else 0), a, rng.randrange(1, 10**6), rng.randrange(9)) for p in range(12) for a in (0, 1) for _ in range(rng.choice((0, 1, 5, 40))))
    rows.sort(key=lambda r: r[:2])
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + 7]], t) for i, t in enumerate((pa.int64(), pa.int8(), pa.int64(), pa.int64()))], names=list("pakn")) for k in range(0, len(rows), 7)]
    part_of = {r[2]: r[0] for r in rows}
    whole = {p: sorted(r[2] for r in rows if r[0] == p and r[1] == 0) for p, *_ in rows}
    for held in (1, 20, 10**6):
        monkeypatch.setattr(ctw, "HELD", held)
        asked = Counter()
        for split, codes, _, asks, _ in ctw._gathered(iter(batches)):
            own = defaultdict(list)
            for c in codes.tolist():
                own[part_of[c]].append(c)
            for a in asks.tolist():
                assert own[part_of[a]] == whole[part_of[a]] and split == bool(part_of[a] & ctw._SPLIT)
                asked[a] += 1
            assert all(sorted(v) == whole[p] for p, v in own.items())
        assert asked == Counter(r[2] for r in rows if r[1] == 1)


def test_ctw_is_a_distribution_and_follows_its_definition():
    text = b"abracadabra abracadabra"
    depth = 2
    codes = np.sort(ctw._runs([text], depth)[0])
    keys, counts = np.unique(codes, return_counts=True)
    layers, _ = ctw.weighted(keys, counts, 0, depth)
    context = (ord("a") << 8 | ord("b")) << 9
    p = 10 ** ctw.log10_probability(np.array([context | s for s in range(257)], np.uint64), layers, depth)
    assert math.isclose(p.sum(), 1, rel_tol=1e-6) and p.argmax() == ord("r")
    # the root's weighted probability of the first decision, from the definition
    seq = [(b"\n\n" + text)[i : i + 2] for i in range(len(text) + 1)]
    ends = [0] * len(text) + [1]

    def kt(bits):
        a = b = 0
        out = 0.0
        for x in bits:
            out += math.log(((b if x else a) + 0.5) / (a + b + 1))
            a, b = a + (not x), b + x
        return out

    def weighted(context, d):
        bits = [e for s, e in zip(seq, ends, strict=True) if s.endswith(context)]
        if d == depth:
            return kt(bits)
        longer = sum(weighted(bytes([x]) + context, d + 1) for x in {s[-1 - len(context)] for s in seq if s.endswith(context)})
        return np.logaddexp(math.log(0.5) + kt(bits), math.log(0.5) + longer)

    own = math.exp(math.log(0.5) + kt(ends) - weighted(b"", 0))
    assert math.isclose(layers[2].w[0, 0], own, rel_tol=1e-4)


def test_warc_round_trip(spark):
    same = "x" * 150
    rows = [(3, "u", same), (1, "a b\n", same), (2, None, same), (4, "u 1.2.3.4 20010203 x 7", None), (5, "", "y"), (6, " ", "y"), (None, "u:", same), (7, "http://é", "ä\r\n\r\nWARC/1.0\r\n" * 50), (8, "u:" + "v" * 600_000, "z" * 3_000_000), (9, "u:", "end")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record string")
    for version in (1, 2):
        arc, out = warc.fresh(spark, "arc"), warc.fresh(spark, "warc")
        warc.write_arc(d, arc, version, per_file=2, file_bytes=300)
        read = warc.read_arc(spark, arc)
        assert warc.errors(read).count() == 0 and read.where("kind = 'warcinfo'").count() >= 4
        warc.write_warc(warc.convert(read, warc.read_arc(spark, arc, payloads=False)), out, per_file=3)
        every = warc.read_warc(spark, out).collect()
        assert sum(r["record_type"] == "warcinfo" for r in every) >= 4
        got = {r["page_id"]: r for r in every if r["record_type"] != "warcinfo"}
        assert len(got) == len(rows) and len({r["record_id"] for r in got.values()}) == len(rows)
        for p, _, html in rows:
            data = (html or "").encode()
            assert (got[p]["payload_bytes"], got[p]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
            assert (got[p]["record_type"], got[p]["refers_to"]) == (("revisit", 1) if html == same and p != 1 else ("response", None))
            assert got[p]["refers_to_id"] == (got[1]["record_id"] if html == same and p != 1 else None)
        assert got[7]["warc_date"] == "2000-01-01T00:00:00Z" and len(got[8]["url"]) == 600_002


def test_archives_of_empty_and_long_tables(spark, tmp_path):
    kind = "page_id long, url string, html string"
    arc, out = warc.fresh(spark, "arc"), warc.fresh(spark, "warc")
    warc.write_arc(spark.createDataFrame([], kind), arc)
    warc.write_warc(warc.convert(warc.read_arc(spark, arc), warc.read_arc(spark, arc, payloads=False)), out)
    assert warc.read_warc(spark, out).count() == 0
    many = spark.createDataFrame([(i, "u:", "t" * 1000) for i in range(4000)], kind).coalesce(1)
    arc = str(tmp_path / "arc")
    warc.write_arc(many, arc, file_bytes=2_000_000)  # 4 MB and more in rows of 1 MB: three files
    sizes = [sum(len(r.get("block", b"")) for r in warc.parse_arc(f.read_bytes())) for f in (tmp_path / "arc").glob("*.gz")]
    assert len(sizes) == 3 and max(sizes) < 3_200_000 and warc.read_arc(spark, arc).where("kind = 'response'").count() == 4000
    assert all(next(warc.parse_arc(f.read_bytes()))["opening"] for f in (tmp_path / "arc").glob("*.gz"))


def test_damage_is_reported_and_sound_records_are_kept(spark, tmp_path):
    import gzip

    rec = lambda n: b"http://a/%d 1.2.3.4 20010203040506 text/html 5\nhell%d\n" % (n, n)
    long = b"http://" + b"v" * 600_000 + b" 1.2.3.4 20010203 text/html 2\nhi\n"
    data = b"nonsense of some kind\nand more\n" + rec(1) + b"http://b 1.2.3.4 20010203040506 text/html 9999999\nshort\n" + rec(2) + long + b"x" * 200_000 + b"\n" + rec(3)
    for packed in (data, gzip.compress(data[:50]) + gzip.compress(data[50:])):
        got = list(warc.parse_arc(packed))
        assert [r["block"] for r in got if "error" not in r] == [b"hell1", b"hell2", b"hi", b"hell3"]
        assert [r["error"][:20] for r in got if "error" in r] == ["bad header line: non", "the declared length ", "bad header line: xxx"]
    (tmp_path / "a.txt").write_bytes(data)
    read, again = (warc.read_arc(spark, str(tmp_path), p) for p in (True, False))
    assert warc.errors(read).agg(F.sum("n")).first()[0] == 3
    assert warc.convert(read, again, skip_errors=True).count() == 4
    with pytest.raises(Exception, match="damaged archive"):
        warc.convert(read, again).collect()
    cut = gzip.compress(data)[:-9]
    assert sum("error" not in r for r in warc.parse_arc(cut)) >= 2


def test_arc_parser_follows_versions_and_lengths():
    v1 = b"filedesc://x 0.0.0.0 20010203040506 text/plain 77\n" + b"1 0 own\nURL IP-address Archive-date Content-type Archive-length\n".ljust(77, b"\n")
    rec = b"http://a b/c 1.2.3.4 20010203040506 text/html 5\nhello\n"
    got = list(warc.parse_arc(v1 + b"\n" + rec + rec))
    assert [g["url"] for g in got[1:]] == ["http://a b/c"] * 2 and got[1]["block"] == b"hello"
    assert "error" in list(warc.parse_arc(v1 + b"\nhttp://a 1.1.1.1 20010203 t 99\nshort"))[-1]
    assert "error" in list(warc.parse_arc(v1 + b"\nnonsense\n"))[-1]


def test_dates_of_any_length(spark):
    d = [(1, "u:", x, "response", 1, 0, "d", b"HTTP/1.0 200 OK\r\n\r\n", b"", None) for x in ("20010203040506", "200102030405", "20010203")]
    kind = "version int, url string, date string, kind string, page_id long, payload_bytes long, payload_digest string, head binary, payload binary, error string"
    r = spark.createDataFrame(d, kind)
    said = sorted(re.search(rb"WARC-Date: (\S+)", bytes(x["record"]))[1] for x in warc.convert(r, r).collect())
    assert said == [b"2001-02-03T00:00:00Z", b"2001-02-03T04:05:00Z", b"2001-02-03T04:05:06Z"]


def test_crf_held_out_accuracy_and_cases(spark):
    crf, rng = html_crf.fitted(), random.Random(77)
    right = total = 0
    for _ in range(60):
        b = html_crf.blocks(html_crf.labelled_page(rng))
        y = [int(bool(x.main)) for x in b]
        right += sum(a == c for a, c in zip(y, crf.decode(html_crf.features(b)), strict=True))
        total += len(y)
    assert right / total > 0.98
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One&nbsp;two<br>three <b>bold.<p>Four < five.</p><script>var x='<p>';</script></article><div class=comments><p>Nice!</p></div><footer>&copy; z</footer>"
    d = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3), (3, "u", "", 3)], "page_id long, url string, html string, text int")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in html_crf.extract(d).orderBy("page_id").collect()]
    assert out[0][1] == "A & B\n\nOne two three bold.\n\nFour < five." and out[1:] == [(2, "", 0), (3, "", 0), (3, "", 0)]


def test_crf_on_pages_labelled_by_hand():
    from .labelled_pages import PAGES

    crf, right, found, wanted = html_crf.fitted(), 0, 0, 0
    for page, want in PAGES:
        got = html_crf.main_blocks(page, crf)
        assert crf.labels(html_crf.blocks(page)) == crf.decode(html_crf.features(html_crf.blocks(page)))
        right += sum((Counter(got) & Counter(want)).values())
        found, wanted = found + len(got), wanted + len(want)
    assert 2 * right / (found + wanted) > 0.95


def test_crf_loses_no_page():
    crf, art = html_crf.fitted(), "<article><h1>Big News</h1><p>Some long text is here for you to read.</p>"
    both = ["Big News", "Some long text is here for you to read."]
    for before in ("<html><head><title>t</title><body>", "<head><title>t</title>", "<body><noscript><p>Turn on scripts.</p>", "<title>t", "<body><template>", "<body><div class='a>", "<head><noscript><link rel=x></noscript>"):
        assert html_crf.main_blocks(before + art, crf) == both, before
    assert html_crf.main_blocks("<article><p>Before <object data=x>the fallback</object> and <math><mi>a</mi><mo>=</mo><mi>b</mi></math> after.</p></article>", crf) == ["Before the fallback and a=b after."]
    bare = "<p>Some long text is here for you to read.</p><p>Another paragraph follows the first.</p>"
    assert html_crf.main_blocks(bare, crf) == ["Some long text is here for you to read.", "Another paragraph follows the first."]
    assert html_crf.main_blocks("<p>a &#" + "9" * 5000 + "; b", crf) == ["a \ufffd b"]


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "x" + "</div>" * 90_000, "<div class='c'>text here" * 40_000, '<div class=">text <p>' * 50_000, "<a '" * 250_000, "<a " * 300_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 200_000, "<" * 1_000_000, "<title>x" * 100_000])
def test_crf_reads_hostile_pages_in_linear_time(page):
    import time

    crf, began = html_crf.fitted(), time.process_time()
    html_crf.main_blocks(page, crf)
    assert time.process_time() - began < 5  # about a second; square cost took minutes


def test_crf_decodes_and_learns_as_by_enumeration():
    import itertools

    rng = random.Random(4)
    crf = html_crf.Crf()
    crf.weights = {k: [rng.gauss(0, 1), rng.gauss(0, 1)] for k in "abcd"}
    crf.moves, crf.start = [[rng.gauss(0, 1) for _ in "01"] for _ in "01"], [rng.gauss(0, 1) for _ in "01"]
    page, y = [["a", "b"], ["c"], ["a", "d"], ["b"], []], [1, 0, 0, 1, 1]

    def log_score(labels):
        return crf.start[labels[0]] + sum(crf.weights[k][v] for f, v in zip(page, labels, strict=True) for k in f) + sum(crf.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

    every = list(itertools.product((0, 1), repeat=len(page)))
    assert tuple(crf.decode(page)) == max(every, key=log_score)

    def likelihood():
        return log_score(y) - math.log(sum(math.exp(log_score(v)) for v in every))

    slope = {}
    for k in "abcd":  # by differences
        low = likelihood()
        crf.weights[k][1] += 1e-6
        slope[k] = (likelihood() - low) / 1e-6
        crf.weights[k][1] -= 1e-6
    before = {k: crf.weights[k][1] for k in "abcd"}
    crf.step(page, y, 1e-4, 0.0)
    assert all(math.isclose((crf.weights[k][1] - before[k]) / 1e-4, slope[k], abs_tol=1e-3) for k in "abcd")


def test_crf_gradient_step_raises_the_likelihood():
    page = [["a"], ["b"], ["a"]]
    crf = html_crf.Crf()
    for _ in range(200):
        crf.step(page, [1, 0, 1], 0.1, 0.0)
    assert crf.decode(page) == [1, 0, 1] and crf.decode([]) == []


def test_spans_stand_in_another_document(spark):
    rng = random.Random(17)
    shared = [some(rng, rng.randint(20, 90)) for _ in range(12)]
    rows = [(None if i % 9 == 0 else i, " ".join(rng.choice((some(rng, 30), rng.choice(shared))) for _ in range(rng.randint(1, 7)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t.encode())
    every = [(i, x) for i, xs in texts.items() for x in xs]
    found = chunks.spans(d).collect()
    assert len(found) > 30 and any(r["doc_id"] is None for r in found)
    for r in found:
        own = next(x for x in texts[r["doc_id"]] if r["start"] + r["length"] <= len(x) and _key(spark, x) == r["text_key"])
        part = own[r["start"] : r["start"] + r["length"]]
        others = [x for i, x in every if i != r["doc_id"]]
        held = [any(part[k : k + 16] in x for x in others) for k in range(0, len(part) - 15, 5)]
        assert held[0] and held[-1] and sum(held) >= 0.85 * len(held)  # where two passages meet, a window may lie across
    cut = Counter((r["doc_id"], r["text"]) for r in chunks.cut_repeats(d).collect())
    assert sum(cut.values()) == 60 and all((None, t) in cut for i, t in rows if i is None)  # the smallest keeps all


def _key(spark, data, made={}):  # noqa: B006
    if data not in made:
        made[data] = spark.range(1).select(F.xxhash64(F.lit(data.decode())).alias("k")).first()["k"]
    return made[data]


def brute_quality(rows):
    """doc_id -> kept, by the rules' counts, votes, expectation-maximisation and posterior, row by row."""
    import unicodedata

    def votes(t):
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        n, chars = len(w), sum(map(len, w))
        kind = [unicodedata.category(c) for c in t]
        letters, upper = sum(k[0] == "L" for k in kind), kind.count("Lu")
        marks = sum(k[0] not in "LN" and c not in " \t\n\x0b\x0c\r.,;:'’\"()-" for c, k in zip(t, kind, strict=True))
        at = defaultdict(list)
        for i in range(n - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeat = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
        of = lambda a, b: a / b if b else None
        vote = lambda v, good, bad: 0 if v is None else -1 if bad(v) else 1 if good(v) else 0
        return n < 10 or 100 * repeat > 20 * n, (
            vote(n, lambda v: v >= 50, lambda v: v < 20), vote(of(chars, n), lambda v: 3.5 <= v <= 9, lambda v: v < 2.5 or v > 12),
            vote(of(len(re.findall(r"[#*$%&|<>]", t)), n), lambda v: v <= 0.01, lambda v: v > 0.1), vote(of(letters, chars), lambda v: v >= 0.9, lambda v: v < 0.75),
            vote(of(upper, letters), lambda v: v <= 0.15, lambda v: v > 0.4), vote(of(marks, n), lambda v: v <= 0.03, lambda v: v > 0.25),
            vote(of(len(lines) - len(set(lines)), len(lines)), lambda v: v <= 0.05, lambda v: v > 0.3), vote(of(repeat, n), lambda v: v <= 0.05, lambda v: v > 0.2),
            vote(of(len(set(w)), n), lambda v: v >= 0.35, lambda v: v < 0.15 and 50 <= n < 2000),
        )

    judged = {d: votes(t) for d, t, _ in rows}
    vs = [v for _, v in judged.values()]
    p = np.array([(0.95, 0.4, 0.1)[min(2, v.count(-1))] for v in vs])
    prior = 0.9
    for _ in range(200):
        good, bad, old = p.sum(), (1 - p).sum(), prior
        prior = min(0.99, max(0.5, good / len(vs)))
        table = []
        for k in range(9):
            on = {v: (1 / 3 + p[[x[k] == v for x in vs]].sum(), 1 / 3 + (1 - p)[[x[k] == v for x in vs]].sum()) for v in (1, 0, -1)}
            chance = {v: (a / (good + 1), b / (bad + 1)) for v, (a, b) in on.items()}
            if chance[-1][0] > chance[-1][1] or chance[1][0] < chance[1][1]:
                chance = {v: (1.0, 1.0) for v in on}
            table.append(chance)
        p = np.array([prior * math.prod(c[x][0] for c, x in zip(table, v, strict=True)) / (prior * math.prod(c[x][0] for c, x in zip(table, v, strict=True)) + (1 - prior) * math.prod(c[x][1] for c, x in zip(table, v, strict=True))) for v in vs])
        if abs(old - prior) < 1e-7:
            break
    return {d: not failed and q >= 0.5 for (d, (failed, _)), q in zip(judged.items(), p, strict=True)}


def test_quality_by_brute_force(docs, rows, spark):
    rng = random.Random(3)
    more = [*rows, *[(1000 + i, " ".join(some(rng, 9).capitalize() + "." for _ in range(12)), "s") for i in range(80)], *[(2000 + i, " ".join(x + rng.choice(("###", "&&&", "$$$", "")) for x in some(rng, rng.randint(5, 80)).split()), "s") for i in range(15)]]
    d = spark.createDataFrame(more, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["kept"] for r in quality.judged(d).collect()} == brute_quality(more)


def brute_pipeline(spark, rows):
    """The rows of the pipeline, stage by stage in plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    good = brute_quality(rows)
    now = [r for r in rows if good[r[0]]]
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for d, t, _ in now:
        for s in t.split("\n"):
            held[key(s)].add(d)
    gone = lambda d, s: len(key(s)) >= 20 and len(held[key(s)]) >= 3 and max(held[key(s)]) != d
    now = [(d, "\n".join(s for s in t.split("\n") if not gone(d, s)), s_) for d, t, s_ in now]
    named = brute_groups(now, 80)
    now = [r for r in now if named[r[0]][1] == r[0]]
    sizes = Counter()
    for _, t, s in now:
        sizes[s] += len(words(t))
    order = by_code_point(sizes)
    goal = fair_shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    d = spark.createDataFrame(now, "doc_id long, text string, source string")
    turn = {r["doc_id"]: r["h"] for r in d.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("h")).collect()}
    taken = []
    for i, s in enumerate(order):
        first, last = mixing.SCHEDULES[i % 3]
        before = 0
        for r in sorted((r for r in now if r[2] == s), key=lambda r: ((turn[r[0]] % 2**64 >> 20) % 256, turn[r[0]])):
            n = len(words(r[1]))
            for k in (0, 1):
                x = before + n / 2 + k * sizes[s]
                if x < goal[s]:
                    u, a, b = x / goal[s] * (first + last) / 2, first, last - first
                    taken.append((u / a if b == 0 else (math.sqrt(a * a + 2 * b * u) - a) / b, r[0], r[1]))
            before += n
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for place, (_, d_, text) in enumerate(sorted(taken)):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        pieces += [(-n, place, start, d_, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)) for start, n in packing.cuts(len(ids))]
    return [(d_, start, -n, crc, total, i, 0) for i, (n, _, start, d_, crc, total) in enumerate(sorted(pieces))]


def test_pipeline_by_brute_force(spark, rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "curriculum_mix", "packing"]
    rng = random.Random(51)
    line = "One line of text that many documents of the corpus hold"
    made = [(3000 + i, "\n".join([" ".join(some(rng, 9).capitalize() + "." for _ in range(rng.randint(3, 9))), line, some(rng, 20)]), f"s{i % 5}") for i in range(60)]
    copies = [(4000 + i, made[i % 20][1] + " and more", f"s{i % 3}") for i in range(25)]
    every = [*rows, *made, *copies]
    d = spark.createDataFrame([(*r, "a", "b") for r in every], "doc_id long, text string, source string, _id string, POSITION string")
    got = corpus_pipeline.run_on(spark, d).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert sorted(map(tuple, got), key=lambda r: r[5]) == brute_pipeline(spark, every)


def test_pipeline_of_nothing_and_of_nulls(spark):
    import corpus_pipeline

    kind = "doc_id long, text string, source string, n_lines int, __sl_key string"
    assert corpus_pipeline.run_on(spark, spark.createDataFrame([], kind)).count() == 0
    rng = random.Random(52)
    text = " ".join(some(rng, 9).capitalize() + "." for _ in range(9))
    rows = [(None, None, None), (1, "", "s"), (None, text, None), (None, text, None), (2, text + " once more", None), (2, " ".join(some(rng, 9).capitalize() + "." for _ in range(9)), "s")]
    out = corpus_pipeline.run_on(spark, spark.createDataFrame([(*r, 1, "k") for r in rows], kind)).collect()
    assert {r["doc_id"] for r in out} <= {None, 2} and len(out) > 3
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))


def test_pipeline_over_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where("length > 2048").count() == 0


CONTRACT = {
    "op1_ctw_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_arc_to_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op3_curriculum_mix": "doc_id size source_size target taken",
    "op4_weak_supervision": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_crf_main_text": "page_id url text n_chars",
    "op6_closed_syncmers": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_chunk_repeats": "doc_id start length",
    "op8_binary_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_setsketch_groups": "doc_id n_shingles component_id kept",
    "op10_line_dedup": "doc_id n_lines n_dropped kept_sha256",
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_queries_on_planted_and_on_empty_tables(spark, rows, tmp_path, name):
    from sightline.llm.queries import QUERIES

    pages = [(1, "u", "<article><h1>A b c</h1><p>Some long text is here for you to read.</p></article>"), (2, None, None), (None, "x", "")]
    for at, docs_, pages_ in (("full", rows, pages), ("none", [], [])):
        spark.createDataFrame(docs_, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.createDataFrame(pages_, "page_id long, url string, html string").write.parquet(f"{tmp_path}/{at}/pages.parquet")
    out = QUERIES[name](spark, f"{tmp_path}/full")
    names = CONTRACT[name].split()
    assert out.columns[: len(names)] == names
    got = out.collect()
    once = {"op2_arc_to_warc": 3, "op5_crf_main_text": 3}.get(name, len(rows))
    assert len(got) == once or name in ("op7_chunk_repeats", "op8_binary_packing")
    assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0
    by = {r[0]: r for r in got}
    if name == "op6_closed_syncmers":
        order = sorted(rows, key=lambda r: -r[0])
        for (d, t, _), (_, n, _) in zip(order, order[1:] + order[:1], strict=True):
            t, n = t or "", n or ""
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert (by[d]["n_chars"], by[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= by[d]["near_edited"] <= 1
        assert by[11]["fingerprint"] == by[12]["fingerprint"] and by[12]["near_next"] == 1.0 and len(by[11]["fingerprint"]) % 8 == 0
    if name == "op9_setsketch_groups":
        assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in by.items()} == {d: (n, c, c == d) for d, (n, c) in brute_groups(rows).items()}
    if name == "op4_weak_supervision":
        assert {d: r["kept"] for d, r in by.items()} == brute_quality(rows)
    if name == "op1_ctw_scores":
        assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0) for d, r in by.items())
