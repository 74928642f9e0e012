"""Decontamination, line dedup, SimHash, passages and packing against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cribra.llm import decontam, lines, packing, passages, simhash
from cribra.llm.queries import QUERIES

LONG = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 4000) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, a hot source."""
    rng = random.Random(5)
    out = [(1, None, None, None, None), (2, "", "en", "s0", 0), (None, "no id here", "en", "s0", 10),
           (3, "   \t\n ", "en", "s1", 6), (4, "one", "en", "s1", 3), (5, "one", None, "s0", 3)]
    base = words(rng, 400)
    passage = words(rng, 70)
    for i in range(10, 60):
        own = words(rng, rng.randrange(20, 300))
        if i % 5 == 0:
            own = base[:]
            own[i % 400] = "edited"
        if i % 7 == 0:
            at = rng.randrange(len(own))
            own[at:at] = passage
        text = " ".join(own)
        if i % 3 == 0:
            text = "Shared  Line\n" + text.replace(" w1", "\nw1")
        out.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
    out.append((70, " ".join(words(rng, 30_000)), "de", "hot", 1))
    out.append((71, "same word " * 3000, "de", "hot", 1))
    out += [out[20], out[20]]  # repeated rows
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, LONG).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], LONG)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# decontamination

def plain_words(text):
    out, now = [], ""
    for ch in text or "":
        c = ch.lower() if "A" <= ch <= "Z" else ch
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            out, now = (out + [now] if now else out), ""
        else:
            now += c
    return out + [now] if now else out


def brute_contamination(text, items, n=13):
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = plain_words(t)
        if item is None or not iw:
            continue
        wins = {tuple(iw[i:i + n]) for i in range(max(1, len(iw) - n + 1))}
        k = min(n, len(iw))
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def items_from(rows):
    text = {r[0]: r[1] for r in rows}
    return [(1, " ".join(text[10].split()[30:60])), (2, "ONE"), (10, " ".join(text[11].split()[:13])),
            (3, None), (4, "..."), (None, "one"), (5, "é" * 3 + " w1, w2"), (6, " ".join(text[70].split()[90:104])),
            (2, "no id")]


@pytest.mark.parametrize("block", [10**6, 200])
def test_contamination_equals_brute_force(spark, docs, rows, block):
    items = items_from(rows)
    got = decontam.find_contamination(docs, bench(spark, items), block=block).collect()
    want = sorted(((r[0], *brute_contamination(r[1], items)) for r in rows), key=repr)
    have = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr)
    assert have == want
    assert any(r[4] for r in have) and any(r[2] and not r[4] for r in have)


def test_remove_documents_and_spans(spark, docs, rows):
    items = items_from(rows)
    extra = docs.withColumns({"spans": F.lit("x"), "n_words": F.lit(1), "items": F.lit(2)})
    kept = decontam.remove_documents(extra, bench(spark, items))
    assert kept.columns == extra.columns
    want = sorted(repr(r[0]) for r in rows if not brute_contamination(r[1], items)[3])
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want
    cut = decontam.remove_spans(extra, bench(spark, items))
    assert cut.schema == extra.schema
    for r in cut.collect():
        n, hit, *_ = next(brute_contamination(x[1], items) for x in rows if x[0] == r.doc_id)
        assert len(plain_words(r.text)) == n - hit
        assert (r.text is None) == (r.doc_id == 1)


def test_decontamination_empty_tables(spark, docs, none, rows):
    empty = bench(spark, [])
    assert decontam.find_contamination(none, bench(spark, [(1, "a")])).count() == 0
    got = decontam.find_contamination(docs, empty)
    assert got.count() == len(rows) and got.where("n_hit > 0").count() == 0


# lines

def brute_lines(texts, least, keep=None):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(lower)
    seen = defaultdict(list)
    for i, t in texts:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            seen[k].append(i)
    out = []
    for i, t in texts:
        kept, spared = [], set()
        all_ = (t or "").split("\n")
        for x in all_:
            k = key(x)
            gone = len(seen[k]) >= least
            if gone and keep and i == min(y for y in seen[k] if y is not None) and k not in spared:
                spared.add(k)
                gone = False
            if not gone:
                kept.append(x)
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("max_bytes", [lines.MAX_BYTES, 1])
def test_lines_equal_brute_force(docs, rows, keep, max_bytes):
    extra = docs.withColumns({"n_lines": F.lit(7), "__gone": F.lit(8)})
    got = lines.dedup_lines(extra, min_docs=3, id_col="doc_id", keep=keep, max_bytes=max_bytes)
    have = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=repr)
    assert have == brute_lines([(r[0], r[1]) for r in rows], 3, keep == "first")
    assert sum(r[2] for r in have) > 10
    same = lines.dedup_lines(extra, min_docs=3, counts=False)
    assert same.schema == extra.schema and same.where("doc_id = 1 and text is null").count() == 1


def test_lines_broadcast_in_blocks(docs, rows):
    keys = lines.repeated_lines(docs, min_docs=2)
    got = lines.drop_lines(docs, keys, block=5)
    have = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=repr)
    assert keys.count() > 10 and have == brute_lines([(r[0], r[1]) for r in rows], 2)


def test_lines_empty_table(none):
    assert lines.dedup_lines(none).count() == 0


# simhash

def brute_fingerprint(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = (text or "").translate(lower)
    for s in "\t\n\x0b\x0c\r":
        w = w.replace(s, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(docs, rows):
    got = simhash.simhash_components(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps, 4)
    least = {c: min((r[0] for r, k in zip(rows, comp) if k == c and r[0] is not None), default=None)
             for c in set(comp)}
    want = sorted(((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert len(set(comp)) < len(set(fps))


@pytest.mark.parametrize("limit", [simhash.BUCKET_ROWS, 8, 1])
def test_near_links_span_every_component(spark, limit):
    rng = random.Random(limit)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.choice([0, 1, 30])):  # chains of neighbours up to four bits apart
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(df, 4, limit).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[r.a]] ^ fps[at[r.b]]) for r in links)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = find(at[r.a]), find(at[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute_components(fps, 4)


def test_bucket_index_is_exact_in_a_dense_group():
    import numpy as np
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([1 << a | 1 << b | 1 << c for a, b, c in rng.integers(0, 64, (3000, 3))], np.uint64))
    links = simhash.bucket_links(fps)
    assert len(links) == len(fps) - 1  # all within reach of each other: one tree
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) > 0).all()


def test_keep_one_of_each_component(docs, rows):
    extra = docs.withColumns({"fp": F.lit(1), "root": F.lit(2), "__h": F.lit(3)})
    kept = simhash.keep_one(extra)
    assert kept.columns == extra.columns
    comp = brute_components([brute_fingerprint(r[1]) for r in rows], 4)
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None and (c not in least or r[0] < least[c]):
            least[c] = r[0]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
    assert kept.count() == len(set(comp))


def test_simhash_empty_table(none):
    assert simhash.simhash_components(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_linked_node_pairs_are_not_searched_again(monkeypatch):
    import numpy as np
    rng, tried = random.Random(12), []
    base = [rng.getrandbits(64) for _ in range(3)]
    family = {base[0] ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {base[0]}
    fps = np.array([*family, *base[1:], base[1] ^ 3], np.uint64)
    link = simhash.Forest.link
    monkeypatch.setattr(simhash.Forest, "link", lambda self, a, b: (tried.append(len(a)), link(self, a, b))[1])
    monkeypatch.setattr(simhash, "CHUNK", 1 << 12)
    links = simhash.bucket_links(fps)
    # Every pair of the family is within 4 bits: one component, and one of the two others.
    assert len(links) == len(family) - 1 + 1
    assert sum(tried) < len(family) ** 2 / 8


# passages

def test_shared_passages_are_found_and_others_are_not(docs, rows):
    got = passages.duplicate_passages(docs).collect()
    text = {r[0]: (r[1] or "").lower().split() for r in rows}
    pair = defaultdict(set)
    for i, w in text.items():
        for k in range(len(w) - 49 if i is not None else 0):
            pair[tuple(w[k:k + 50])].add(i)
    exact = set().union(*(v for v in pair.values() if len(v) > 1))
    found = {r.doc_id for r in got} | {r.other_id for r in got}
    assert exact <= found and len(exact) > 10
    assert 70 not in found and 71 not in found and 4 not in found
    for r in got:
        a = text[r.doc_id][r.start_word:r.start_word + r.n_words]
        b = text[r.other_id][r.other_start:r.other_start + r.other_words]
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert r.n_words >= 50 and len(x & y) / len(x | y) >= 0.8 - 1e-9
        assert abs(r.similarity - len(x & y) / len(x | y)) < 1e-9


def test_compact_windows_cover_each_subsequence_once():
    import numpy as np
    rng = np.random.default_rng(3)
    for ties in (False, True):
        h = (rng.integers(0, 6, 40) if ties else rng.permutation(40)).astype(np.uint64)
        found = passages.compact_windows(h, 5, ties)
        for i in range(40):
            for j in range(i + 4, 40):
                c = i + int(h[i:j + 1].argmin())
                assert sum(left <= i <= m <= j <= right and h[m] == h[c] for left, m, right in found) >= 1
                assert sum(left <= i <= m <= j <= right for left, m, right in found) == 1


def _longest_similar(a, b, t, similarity):
    """Tokens of the longest similar ranges between two matches, by trying all of them."""
    pairs = [(i, j) for i, x in enumerate(b) for j, y in enumerate(a) if x == y]
    best = 0
    for i, j in pairs:
        for m, n in pairs:
            size = min(m - i, n - j) + 1
            if size < t or size <= best:
                continue
            x, y = set(b[i:m + 1].tolist()), set(a[j:n + 1].tolist())
            if len(x & y) / len(x | y) >= similarity:
                best = size
    return best


@pytest.mark.parametrize("t", [1, 2, 5, 46])
def test_windows_of_many_texts_are_those_of_each(t, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(t)
    sizes = [0, t - 1, t, t + 1, 0, 300, 3, 1000, 40, 0]
    one_by_one, plain = [], passages.compact_windows
    monkeypatch.setattr(passages, "compact_windows", lambda *x: one_by_one.append(len(x[0])) or plain(*x))
    for different in (1, 3, 30, 1 << 60):
        parts = [rng.integers(0, different, n).astype(np.uint64) * np.uint64(8) for n in sizes]
        h, counts = np.concatenate(parts), np.array(sizes)
        got = np.stack(passages.compact_windows_of_all(h, counts, t)).T.tolist()
        starts = np.cumsum(counts) - counts
        want = [[n, *(int(x + starts[n]) for x in w)] for n, part in enumerate(parts) for w in plain(part, t, True)]
        assert sorted(got) == sorted(want)
        # Windows of one hash and text come as from the text itself: which one links goes by it.
        for h_and_text in {(n, int(h[c])) for n, _, c, _ in want}:
            assert [x for x in got if (x[0], int(h[x[2]])) == h_and_text] == [
                x for x in want if (x[0], int(h[x[2]])) == h_and_text]
    one_by_one.clear()
    passages.compact_windows_of_all(h, counts, t)
    assert not one_by_one  # texts without repeats need no walk of their own


def test_tokens_of_many_texts_are_those_of_each():
    texts = [b"", b"one", b"a b c d", b"a b c d e", b"  ", b"A b C d e f g", b"x " * 50, b"a"]
    tok, counts = passages.tokens_of_all(texts)
    each = [passages.tokens(x).tolist() for x in texts]
    assert counts.tolist() == [len(x) for x in each] == [0, 0, 0, 1, 0, 3, 46, 0]
    assert tok.tolist() == sum(each, [])
    assert [(p, at) for p, at in passages._parts(iter([b"x" * passages.TOGETHER * 7, b"y", b"z"]))][1] == ([b"y", b"z"], 1)


def test_longest_by_sets_equals_trying_all_ranges():
    import numpy as np
    rng = np.random.default_rng(4)
    some = 0
    for n in range(300):
        a, b = (rng.integers(0, (3, 12, 60)[n % 3], rng.integers(6, 60)) for _ in range(2))
        i = np.array([k for k in range(min(len(a), len(b))) if a[k] == b[k] and k % 11])
        if not len(i):
            continue
        broken = np.diff(i) > 1
        best = 3
        for s in [0, *(np.flatnonzero(broken) + 1).tolist()]:
            for e in [*np.flatnonzero(broken).tolist(), len(i) - 1]:
                x, y = set(b[i[s]:i[e] + 1].tolist()), set(a[i[s]:i[e] + 1].tolist())
                if e >= s and i[e] - i[s] + 1 > best and len(x & y) >= 0.7 * len(x | y):
                    best, where = i[e] - i[s] + 1, (s, e)
        got = passages._longest_by_sets(a, b, i, i, 4, 0.7)
        assert (got is None) if best == 3 else got == where
        some += best > 3
    assert some > 20


@pytest.mark.parametrize("length,changed", [
    (50, [25]), (80, [40]), (88, [44]), (130, [43, 86]), (200, [40, 80, 120, 160]), (60, [10, 50]),
    (90, [30, 60]), (70, [])])
@pytest.mark.parametrize("edit", ["change", "insert", "drop"])
def test_edited_passages_are_verified_as_brute_force_does(length, changed, edit):
    rng = random.Random(length)
    one = [f"p{k}" for k in range(length)]
    two = one[:]
    for k in sorted(changed, reverse=True):
        two[k:k + (edit != "insert")] = [] if edit == "drop" else [f"new{k}"]
    sides = [words(rng, 12, 10**9) for _ in range(4)]
    text_a, text_b = sides[0] + one + sides[1], sides[2] + two + sides[3]
    a, b = (passages.tokens(" ".join(w).encode()) for w in (text_a, text_b))
    anchor = 12
    got = passages.verified(a, b, [(anchor, anchor)], 46, 0.8)
    best = _longest_similar(a, b, 46, 0.8)
    assert max((min(ea - sa, eb - sb) for sa, ea, sb, eb, _ in got), default=0) == best
    if edit == "change" and (length, len(changed)) in {(50, 1), (80, 1), (88, 1), (130, 2), (200, 4)}:
        assert best == length - 4
    for sa, ea, sb, eb, j in got:
        x, y = set(a[sa:ea].tolist()), set(b[sb:eb].tolist())
        assert j == len(x & y) / len(x | y) >= 0.8 and min(ea - sa, eb - sb) >= 46


def test_passages_empty_table(none):
    assert passages.duplicate_passages(none).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_windows_meet_the_one_before_whatever_the_batches(spark, size):
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(8 * key, 10 * key + n, 0, 5, 60, None, 100 * key + n, None, None) for key in (1, 2) for n in range(7)]
    rows += [(8, 15, 200, 205, 260, None, 999, None, None), (3, 1, 2, 3, 4, 5, 6, 7, 8)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        made = passages._links(spark.createDataFrame(rows, passages._LINKS)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", now)
    got = {(r.doc, r.hub) for r in made if r.key % 8 == 0}
    want = {(10 * k + n, 10 * k + m) for k in (1, 2) for n in range(1, 7) for m in (0, n - 1)}
    assert got == want
    assert [tuple(r) for r in made if r.key == 3] == [rows[-1]]


@pytest.mark.parametrize("together", [1, 3, 5, 100])
def test_windows_meet_whatever_is_put_together(spark, together):
    rng = random.Random(6)
    rows = [(8 * rng.randrange(4), n, 0, 5, 60, None, rng.randrange(12), None, None) for n in range(80)]
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        made = passages._links(spark.createDataFrame(rows, passages._LINKS), together).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", now)
    want = set()
    for key in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == key]
        for n, r in enumerate(group):
            twin = next((x[1] for x in group[:n] if x[6] == r[6]), None)
            want |= {(r[1], x) for x in ([twin] if twin is not None else [group[0][1], group[n - 1][1]] if n else [])}
    assert {(r.doc, r.hub) for r in made} == want


def test_links_of_a_pair_count_its_votes_across_batches():
    import numpy as np
    import pyarrow as pa
    rng = random.Random(2)
    rows = sorted((rng.randrange(40), rng.randrange(3), rng.choice([0, 0, 30]), 50, 100, rng.randrange(3), 0, 50, 100)
                  for _ in range(300))
    rows.sort(key=lambda r: (r[1], r[5]))
    long = [r for r in rows if min(r[3] - r[2], r[7] - r[6]) + min(r[4] - r[3], r[8] - r[7]) + 1 >= 90]
    for votes in (1, 2, 8):
        want = [r for r in long if len({x[0] & 7 for x in long if (x[1], x[5]) == (r[1], r[5])}) >= votes]
        for size in (1, 2, 7, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k:k + size])],
                                                  names=passages._EDGE) for k in range(0, len(rows), size)]
            got = [tuple(x) for c in passages._supported(batches, 180, votes) for x in np.array(c).T.tolist()]
            assert got == want


# packing

@pytest.mark.parametrize("shard_rows", [10**6, 7])
def test_packing_keeps_every_word_and_no_conflict(docs, rows, shard_rows):
    extra = docs.withColumns({"shard": F.lit(1), "bin_id": F.lit(2), "id": F.lit(3)})
    got = packing.best_fit(extra, capacity=512, shard_rows=shard_rows).collect()
    n = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    placed, bins = defaultdict(list), defaultdict(list)
    for r in got:
        placed[r.doc_id].append((r.start_word, r.n_words))
        bins[r.bin_id].append(r)
    for i in n:
        times = sum(r[0] == i for r in rows)
        assert sum(w for _, w in placed[i]) == times * n[i]
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 512
        assert sorted(r.slot for r in held) == list(range(len(held)))
        used = [source[r.doc_id] for r in held if source[r.doc_id] is not None]
        assert len(used) == len(set(used))
        ids = [r.doc_id for r in held]
        assert len(ids) == len(set(ids))


def test_packing_query_keeps_near_copies_apart(spark, tmp_path):
    rng = random.Random(8)
    base, rows = words(rng, 300), []
    for i in range(12):
        text = base[:]
        text[i * 20] = "edited"
        rows += [(i, " ".join(text), "en", f"s{i}" if i % 3 else None, 1),
                 (100 + i, " ".join(words(rng, 50)), "en", f"t{i}", 1)]
    rows.append((50, " ".join(words(rng, 5000)), "en", "long", 1))
    rows += [rows[0], (None, rows[2][1], None, None, None), (60, None, None, None, None)]
    spark.createDataFrame(rows, LONG).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_best_fit_packing"](spark, str(tmp_path)).collect()
    placed = spark.read.parquet(f"{tmp_path}/documents.parquet")
    component = {r.doc_id: r.component_id for r in simhash.simhash_components(placed).collect()}
    assert len({component[i] for i in range(12)}) < 12
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(component[r.doc_id])
    assert all(len(x) == len(set(x)) for x in bins.values())
    assert any(len(x) > 1 for x in bins.values())
    assert sum(r.n_words for r in got) == sum(len((r[1] or "").split()) for r in rows)


def test_best_fit_takes_the_tightest_compatible_bin():
    put = packing.pack([(8, "a", 1), (6, "b", 2), (4, "a", 3), (2, "b", 4), (2, "c", 4)], 10)
    # 4 of source a passes the bin of 8 (too full) and joins b; 2 of b goes to a's 8; c avoids cluster 4.
    assert put == [(0, 0, 2), (1, 0, 4), (1, 1, 0), (0, 1, 0), (2, 0, 8)]


def test_packing_without_constraints_and_empty(docs, none):
    free = packing.best_fit(docs, source_col=None, capacity=512)
    assert free.select("bin_id").distinct().count() <= packing.best_fit(docs, capacity=512).select("bin_id").distinct().count()
    assert packing.best_fit(none).count() == 0


@pytest.mark.parametrize("versions", [1, 3, 12, 50])
@pytest.mark.parametrize("together", [True, False])
def test_exact_copies_meet_behind_template_versions(spark, versions, together):
    rng = random.Random(versions)
    rows, pairs = [], []
    for g in range(8):
        base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        family = []
        for _ in range(versions):
            other = list(base)
            for k in range(rng.randrange(25), 200, 25):
                other[k] = f"v{rng.randrange(10**9)}"
            family.append(" ".join(other))
        rows += [(1000 * g + i, text, 0) for i, text in enumerate([*family, " ".join(base)])]
        pairs.append((1000 * g + versions, 100_000 + g))
        rows.append((100_000 + g, " ".join(base), 0 if together else 1))
    rows = [r for r in rows if r[2] == 0] + [r for r in rows if r[2] == 1]
    cut = sum(r[2] == 0 for r in rows)
    parts = [rows[:cut], rows[cut:]] if cut < len(rows) else [rows]
    rdd = spark.sparkContext.parallelize(range(len(parts)), len(parts)).flatMap(lambda k: [r[:2] for r in parts[k]])
    got = passages.duplicate_passages(spark.createDataFrame(rdd, "doc_id long, text string")).collect()
    whole = {i for r in got for i, n in ((r.doc_id, r.n_words), (r.other_id, r.other_words)) if n >= 195}
    assert all(copy in whole for _, copy in pairs)
