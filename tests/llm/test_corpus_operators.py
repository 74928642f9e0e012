"""Licence scan, Merkle manifest and conversation trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cribra.llm import licenses, merkle, prefixes


# licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENCE_TEXTS = [
    None, "", " \n", "nothing here", "Licensed under CC-BY 4.0. cc by cc by", "ALL RIGHTS RESERVED. all rights-reserved",
    "General Public License", "x general public license general public", "license general public",
    "MIT License", "Released under the\tMIT\nLicense!", "the mit licensee", "mitlicense",
    "Licensed under the Apache License, Version 2.0.", "apache license version 2", "Apache License Version 3.0",
    "This work is licensed under the GNU General Public License, version 3.", "Kelvin cc by İ CC BY-SA 4.0",
    "é😀 cc by", "cc.by;cc_by", "Redistribution and use in source and binary forms, with or without modification",
    "permission is hereby granted free of charge " + "x " * 40 + "associated documentation files",
    "a " * 60_000 + "all rights reserved " + "b " * 10 + "cc by nc 4 0 " + "é" * 1000]


def brute_licenses(texts):
    words = [WORD.findall((t or "").translate(UPPER)) for t in texts]
    weights = {w: len(f"{len(texts) // (sum(w in set(x) for x in words) + 1):b}")
               for w in licenses.vocabulary(licenses.TEMPLATES)}
    out = []
    for ws in words:
        places = []
        for t in licenses.TEMPLATES:
            for s in range(-len(t.words), len(ws)):
                if all(s + at >= 0 and ws[s + at:s + at + len(k)] == k for at, k in t.key_places()):
                    found = sum(weights[w] for j, w in enumerate(t.words) if 0 <= s + j < len(ws) and ws[s + j] == w)
                    places.append((t.label, t.base, s, found / sum(weights[w] for w in t.words)))
        base = [p[2] for p in places if p[1]]
        out.append((len(ws), len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({p[0] for p in places if p[1]})), ",".join(sorted({p[0] for p in places})),
                    max((p[3] for p in places), default=0.0)))
    return out


def test_licences_equal_brute_force(spark):
    texts = LICENCE_TEXTS + LICENCE_TEXTS[4:7]
    docs = spark.createDataFrame([(i % 20 or None, t, 7, "w") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_words int, words string").repartition(3)
    got = licenses.summary(licenses.scan_licenses(docs)).collect()
    want = [(i % 20 or None, *x) for i, x in enumerate(brute_licenses(texts))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    labels = {x for r in got for x in r.labels.split(",")}
    assert {"cc-by", "gpl", "reserved", "mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "bsd"} <= labels


def test_licences_of_empty_tables_and_native_plan(spark, capsys):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = licenses.summary(licenses.scan_licenses(none))
    assert found.count() == 0
    found.explain()
    assert not re.search("Python|Arrow|Pandas|Exchange", capsys.readouterr().out)
    with pytest.raises(ValueError):
        licenses.Template("x", "some words", ("other words",)).key_places()
    with pytest.raises(ValueError):
        licenses.Template("x", "Upper Case", ())


# Merkle manifest

FIELDS = merkle.FIELDS
DOC = "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity):
    def leaf(r, text):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            at = i - i % arity
            yield level[at:i], level[i + 1:at + arity]
            i //= arity

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in names:
        order[s] = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = levels([leaf(r, r[4]) for r in order[s]])
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(order[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc = leaf(r, text)
            for left, right in path:
                acc = h(*left, acc, *right)
            yield (r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], h(*[x for p in path for side in p for x in side]),
                   acc, acc == top[-1][0])


def manifest(docs, arity=3):
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                 F.translate("text", "\n", "")).otherwise(F.col("text"))
    now = merkle.record_digest(*[cut if f == "text" else F.col(f) for f in FIELDS])
    return sorted(map(tuple, merkle.verify(docs, now, arity=arity).collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_brute_force(spark, arity):
    rng = random.Random(arity)
    rows = [(i, rng.choice(["hot", "hot", "b", "é", None]), rng.choice(["en", None]), rng.choice([None, i]),
             rng.choice([None, "", "one\ntwo", "é😀\n", "plain"])) for i in range(60)]
    rows += [(None, "hot", "en", 1, "no id\n"), (7, "hot", None, 1, "tie"), (7, "hot", None, 2, "tie"), (100, "lone", None, None, "\n"),
             (101, "twice", "en", 3, "a\nb"), (101, "twice", "en", 3, "a\nb"), (102, "", "en", 3, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "t", 1, "d") for r in rows], DOC).repartition(5)
    assert manifest(docs, arity) == sorted(brute_manifest(rows, arity), key=repr)


def test_manifest_of_one_row_and_none(spark):
    one = [(2, None, None, None, "a\nb")]
    docs = spark.createDataFrame([(*r, "t", 1, "d") for r in one], DOC)
    got = manifest(docs)
    assert got == list(brute_manifest(one, 3))
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h()
    assert manifest(docs.limit(0)) == []
    assert merkle.build(docs.limit(0)).root is None


# conversations

TURN = "conv_id long, turn long, role string, text string, seq string, depth int"


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(
                f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        k = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - int(math.fmod(c, 5)), [])[:k] + turns[k:]
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in kids) or 1
        saved[node] = sum(saved[x] for x in kids) + (
            (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(kids), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(turns):
    return sorted(map(tuple, prefixes.trie(prefixes.rebuilt(prefixes.sequences(turns))).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for c in [*range(0, 60), 101, 103, -5, -3]:             # 100 is absent: its group has no first turns
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a", "é", None, "bb"])) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 240) for t in range(9)]      # copies
    long = [(300 + 5 * k, t, "user", f"deep {t if t < 90 else (t, k)}") for k in range(2) for t in range(100 + k)]
    rows += long + [(None, 1, "user", "x"), (5, None, "user", "null turn"), (5, 3, "a", "tie"), (5, 3, "a", "tie"),
                    (400, 0, None, None), (405, 0, "", ""), (410, 0, "user", "é" * 50_000)]
    turns = spark.createDataFrame([(*r, "s", 1) for r in rows], TURN).repartition(4)
    assert trie_of(turns) == brute_trie(rows)
    assert trie_of(turns.limit(0)) == []


def test_trie_of_one_turn_and_chunked_ends(spark, monkeypatch):
    one = [(5, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "s", 1) for r in one], TURN)
    assert trie_of(turns) == brute_trie(one)
    monkeypatch.setattr(prefixes, "CHUNK_BYTES", 50)
    rows = [(c, 0, "user", "hot") for c in range(0, 3000, 5)]
    turns = spark.createDataFrame([(*r, "s", 1) for r in rows], TURN).repartition(7)
    assert trie_of(turns) == brute_trie(rows)


def test_rounds_follow_parting_depths_not_lengths(spark):
    seq = [bytes([k]) * prefixes.CELL for k in range(5)]
    rows = [(b"".join(seq[:2]),), (b"".join(seq[:2]) + seq[3] * 400,), (b"".join(seq[:2]) + seq[4] * 300,), (seq[4] * 9,)]
    assert prefixes.parting_depths(spark.createDataFrame(rows, "seq binary").repartition(3)) == [2, 0]
