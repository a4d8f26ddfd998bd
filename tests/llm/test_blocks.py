"""Operators over whole texts against brute force: long repeats, substring windows, SimHash, decontamination."""

import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tributary.llm")
from tributary.llm import decontaminate, repeats, simhash, substring  # noqa: E402

SCHEMA = "doc_id long, text string, N_WORDS string, block int, key string"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = [("".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 6)))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, other = say(60), say(30)
    rows = []
    for i in range(n):
        kind = i % 6
        text = say(r.randint(1, 90))
        if kind == 1:
            text = f"{say(5)} {passage} {say(7)}"
        elif kind == 2:
            text = f"{passage}\n{other}"
        elif kind == 3 and rows:
            old = rows[r.randrange(len(rows))][1] or ""
            w = old.split(" ")
            if len(w) > 3:
                w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 4:
            text = f"{other}  {say(20)}\t{other} {passage[50:300]}"
        rows.append((i * 7 % n, text, "x", 1, "y"))
    rows += [(1000, None, "x", 1, None), (1001, "", None, None, None), (None, rows[1][1], "x", 1, "y"), (rows[2][0], rows[2][1], "x", 1, "y"), (1002, "a" * 700, "x", 1, "y"), (1003, "ab" * 500, "x", 1, "y"), (1004, " \n\t ", "x", 1, "y"), (1005, say(4000), "x", 1, "y"), (1006, "A!b" * 150 + "tail", "x", 1, "y")]
    return rows


def pairs(rows):
    return [r[:2] for r in rows]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("seed", "length", "size", "hot"), [(3, 200, 8 << 20, 4096), (4, 60, 2000, 4096), (5, 200, 1500, 3), (6, 60, 1500, 0)])
@pytest.mark.parametrize("relayed", [False, True])
def test_repeats(spark, seed, length, size, hot, relayed):
    rows = corpus(seed)
    out = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"), block_bytes=size, hot=hot, relayed=relayed)
    assert got(out) == sorted(brute.repeats(pairs(rows), length), key=str)


def test_pieces_have_the_triggers_of_the_whole(monkeypatch):
    pdf = pd.DataFrame({"text": ["".join(random.Random(8).choice("abc ") for _ in range(5000)), "a" * 3000, "x" * 210, "", "short"]})
    found = []
    for size in (1 << 20, 700):
        monkeypatch.setattr(repeats, "PIECE", size)
        b, of = repeats._Block(pdf, 200), {}
        for p, (i, j) in zip(b.parts, b.runs, strict=True):
            begins = np.concatenate([[0], p.ends[:-1]])
            for t, low, high in zip(p.trigger, p.low, p.high, strict=True):
                s = i + int(np.searchsorted(p.ends, low, side="right"))
                shift = b.at[s] - begins[s - i]
                of |= {(b.own[s], int(q + shift)): int(t + shift) for q in range(low, high + 1)}
        found.append(of)
    assert found[0] == found[1] and len(found[0]) == 4801 + 2801 + 11


def test_strings_in_corpus_order_equal_counting():
    r, length = random.Random(2), 40
    width = repeats.reach(length)
    for _ in range(60):
        made = []
        for _ in range(r.randrange(1, 40)):
            least = r.randrange(width)
            most = r.randrange(least, width)
            made.append((bytes(r.choice([0, 0, 0, 97]) if r.random() < 0.3 else 0 for _ in range(most + length - least)), least, most, r.choice([1, 1, 2])))
        c, least, most, weight = zip(*made, strict=True)
        out = repeats.repeated_strings(list(c), np.array(least), np.array(most), np.array(weight), length)
        seen = {}
        for t, a, b, w in made:
            for d in range(a, b + 1):
                seen[d, t[b - d : b - d + length]] = seen.get((d, t[b - d : b - d + length]), 0) + w
        for k, (t, a, b, _) in enumerate(made):
            assert [bool(v) for v in out[k]] == [a <= d <= b and seen[d, t[b - d : b - d + length]] > 1 for d in range(width)]


@pytest.mark.parametrize(("seed", "window", "size"), [(3, 13, 8 << 20), (4, 5, 2000), (5, 13, 1500)])
@pytest.mark.parametrize("relayed", [False, True])
def test_substring(spark, seed, window, size, relayed):
    rows = corpus(seed)
    out = substring.dedup(spark.createDataFrame(rows, SCHEMA), window=window, outputs=("n_words", "n_removed", "kept_sha256"), block_bytes=size, relayed=relayed)
    assert got(out) == sorted(brute.substring(pairs(rows), window), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.remove_repeats(none).collect() == []
    assert substring.dedup(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert decontaminate.hits(none, none.select(F.col("doc_id").alias("item_id"), "text")).collect() == []


def test_simhash(spark):
    rows = corpus(6, 40)
    out = got(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", simhash.hexed(F.col("fp")), "component_id"))
    fps = [(i, brute.simhash(t)) for i, t in pairs(rows)]
    least = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert out == sorted([(i, f"{fp:016x}", c) for (i, fp), (_, c) in zip(fps, least, strict=True)], key=str)


def test_links_of_planted_fingerprints(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(150)}
    hub = r.getrandbits(64)
    near = {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(64)}  # a ball that fills buckets
    chain = [r.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(fps | near | {*chain} | {0, 1, (1 << 64) - 1, 1 << 63})
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    from tributary.llm.components import components

    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    root = {n: c for n, c in components(simhash.links(df)).collect()}
    nodes = [(sign(f), f) for f in fps]
    assert {i: root.get(i, i) for i, _ in nodes} == dict(brute.components(nodes, lambda a, b: (a ^ b).bit_count() <= 2))


@pytest.mark.parametrize("item_bytes", [1 << 20, 150])
def test_decontaminate(spark, item_bytes):
    rows = corpus(7)
    texts = [t for _, t in pairs(rows) if t and len(t) > 100]
    items = [(1, texts[0][:90]), (2, texts[3].upper()), (3, "b a"), (4, None), (5, " - "), (10, texts[3]), (None, texts[5][20:120]), (3, "b a"), (7, "zzz never")]
    found = decontaminate.hits(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), item_bytes=item_bytes)
    h = F.col("hits")
    out = found.select("doc_id", h["n_words"], decontaminate.n_hit(h), F.size(h["items"]), decontaminate.items_digest(h), decontaminate.n_hit(h) > 0)
    assert got(out) == sorted(brute.contamination(pairs(rows), items, 10), key=str)
