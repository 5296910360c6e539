"""The conversation trie, vector codes and sanitisation against plain versions written from their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from brightledger.llm import conversation_trie, sanitisation, vector_codes

TURNS = "conv_id long, turn long, role string, text string, node string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = set()
    for node, inside in members.items():
        below = [v for v in members if v[: len(node)] == node]
        parents = {v[:-1] for v in members if v}
        saving = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        ends = ",".join(str(c) for c in inside if paths[c] == node)
        out.add((
            inside[0], len(node), members[node[:-1]][0] if node else None, len(inside), sum(len(v) == len(node) + 1 for v in below),
            sum(v not in parents for v in below), saving, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out, len(members)


def trie_of(spark, rows):
    found = conversation_trie.prefix_trie(spark.createDataFrame([(*r, "clash") for r in rows], TURNS))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in found.select(*columns).collect()]


def test_trie_of_odd_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{min(c % 3, t)}") for c in range(12) for t in range(c % 7)]
    rows += [(40, None, None, None), (40, None, None, None), (40, 1, "user", ""), (41, 3, "user", "é" * 50_000), (41, 3, "user", "a"), (41, 3, "user", "a"), (None, 0, "user", "x")]
    rows += [(-7, t, "user", "t0") for t in range(12)] + [(-5, t, "user", "t0") for t in range(3)] + [(9_000_000_000, 0, "user", "late")]
    rows += [(c, 0, "user", "same") for c in range(100, 130)]
    expected, n = brute_trie(rows)
    found = trie_of(spark, rows)
    assert set(found) == expected and len(found) == n


def test_trie_cuts_long_conversations_and_end_lists_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    monkeypatch.setattr(conversation_trie, "ENDS", 3)
    rows = [(0, t, "user", str(t)) for t in range(60)] + [(c, t, "user", str(t)) for c in (5, 10, 15, 20, 25, 30, 35, 40) for t in range(10)]
    rows += [(c, t, "user", str(t % 3)) for c in range(50, 90) for t in range(9)]
    expected, n = brute_trie(rows)
    found = trie_of(spark, rows)
    assert set(found) == expected and len(found) == n


def test_trie_of_an_empty_table(spark):
    assert trie_of(spark, []) == []


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def brute_codes(rows):
    """vec_id, label, code, error, label_error and digest of each row, in Python integers."""
    out = []
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ends = [i * dim // 8 for i in range(9)]
        parts = [(ends[p], ends[p + 1]) for p in range(8)]
        books = [[v[i:j] for _, v, _ in own[:16]] for i, j in parts]

        def nearest(p, x, books=books):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

        for _ in range(6):
            for p, (i, j) in enumerate(parts):
                inside = defaultdict(list)
                for _, v, _ in own:
                    inside[nearest(p, v[i:j])[1]].append(v[i:j])
                books[p] = [[sum(c) // len(inside[e]) for c in zip(*inside[e], strict=True)] if inside[e] else x for e, x in enumerate(books[p])]
        digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for vec_id, v, y in own:
            found = [nearest(p, v[i:j]) for p, (i, j) in enumerate(parts)]
            out.append((vec_id, y, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), digest))
    sums = defaultdict(int)
    for r in out:
        sums[r[1]] += r[3]
    return sorted(((*r[:4], sums[r[1]], r[4]) for r in out), key=str)


def codes_of(spark, rows):
    found = vector_codes.vector_codes(spark.createDataFrame([(*r, "clash") for r in rows], VECTORS))
    return sorted((tuple(r) for r in found.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_codes_of_any_spread(spark, spread):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, spread, (6, 32))
    rows = [(i, (middles[i % 6] + rng.normal(0, spread / 3, 32)).astype(np.float32).tolist(), None if i % 3 else i % 2) for i in range(300)]
    assert codes_of(spark, rows) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    r = random.Random(2)
    flat = [0.5] * 16
    rows = [(7, flat, 1), (7, flat, 1), (None, [-0.25] * 16, None), (3, None, 1), (4, [math.nan] + flat[1:], 1), (5, [math.inf] + flat[1:], 1), (6, [None] + flat[1:], 1)]
    rows += [(i, [r.choice([-1e-9, 0.0, 0.25, 0.5]) for _ in range(16)], 2) for i in range(20, 60)] + [(i, [r.random() for _ in range(i % 12)], 3) for i in range(100, 160)]
    assert codes_of(spark, rows) == brute_codes(rows)
    assert codes_of(spark, []) == []


def test_codes_of_huge_components_have_errors(spark):
    rows = [(i, [3e38 * (-1) ** i] * 8, 1) for i in range(40)]
    assert {r[3] for r in codes_of(spark, rows)} == {0}


def test_codes_are_decoded_to_the_middle_of_their_steps(spark):
    rows = [(i, [i / 16] * 8, 1, "") for i in range(12)]
    ints = vector_codes.integers(spark.createDataFrame(rows, VECTORS))
    books = vector_codes.fitted(ints)
    found = vector_codes.decoded(vector_codes.coded(ints, books), books[8]).orderBy("vec_id").collect()
    assert all(abs(x - r["vec_id"] / 16) <= 0.5 / 4096 for r in found for x in r["approximate"]) and len(found) == 12


def test_cells_measure_fewer_entries_and_find_the_same():
    rng = np.random.default_rng(1)
    x, entries = rng.integers(-2000, 2000, (3000, 4)), rng.integers(-2000, 2000, (16, 4))
    entries[9] = entries[3]
    cells = vector_codes.Cells(entries)
    index, away = cells.nearest(x)
    d = ((x[:, None] - entries) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (away == d.min(1)).all() and cells.measured < 0.4 * d.size


def test_cells_begin_anew_beyond_their_bound(monkeypatch):
    monkeypatch.setattr(vector_codes, "CELLS", 10)
    rng = np.random.default_rng(1)
    x, cells = rng.integers(-9000, 9000, (500, 2)), vector_codes.Cells(rng.integers(-9000, 9000, (16, 2)))
    found = np.concatenate([cells.nearest(x[i : i + 25])[0] for i in range(0, 500, 25)])
    assert (found == ((x[:, None] - cells.entries) ** 2).sum(2).argmin(1)).all() and len(cells.memo) <= 25


DOCS = "doc_id long, text string, row string, base string"
FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def brute_base(text):
    out = []
    for n, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), n, kind, m.end()))
    return ",".join(f"{k}:{i}:{j}" for i, _, k, j in sorted(out))


def brute_spans(rows):
    """Spans with terms, from counts over whole documents in plain Python."""
    unique = {(d, t or "") for d, t in rows}
    docs = {r: sanitisation.identifiers(r[1]) for r in unique}
    taken = lambda r: [(i, j) for i, _, j, _ in docs[r]]
    free = {r: [(m.start(), m.end()) for m in re.finditer(sanitisation.WORD, r[1]) if all(m.end() <= i or m.start() >= j for i, j in taken(r))] for r in unique}
    beside, seen = defaultdict(lambda: (set(), set())), defaultdict(set)
    for r, found in docs.items():
        for i, k, j, value in found:
            near = [p for p in free[r] if p[1] <= i][-5:] + [p for p in free[r] if p[0] >= j][:5]
            words = tuple(r[1][a:b] for a, b in near)
            seen[k, value].add(r)
            for w in words:
                beside[(k, value), w][0].add(words)
                beside[(k, value), w][1].add(r)
    n, high = len(rows), {}
    for (c, w), (ways, inside) in beside.items():
        whole = sum(w in set(re.findall(sanitisation.WORD, t or "")) for _, t in rows)
        content = math.log(n / len(seen[c]))
        if len(ways) >= 3 and content > 0 and math.log(n * len(inside) / len(seen[c]) / whole) / content >= 0.8 - 1e-12:
            high.setdefault(c, set()).add(w)
    out = []
    for d, t in rows:
        r = (d, t or "")
        terms = set().union(*[high.get((k, v), set()) for _, k, _, v in docs[r]]) if docs[r] else set()
        spans = [(i, k, sanitisation.KINDS[k], j) for i, k, j, _ in docs[r]] + [(i, 9, "term", j) for i, j in free[r] if r[1][i:j] in terms]
        out.append((d, brute_base(r[1]), ",".join(f"{k}:{i}:{j}" for i, _, k, j in sorted(spans))))
    return sorted(out, key=str)


def spans_of(spark, rows):
    found = sanitisation.sensitive_spans(spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS))
    return sorted((tuple(r) for r in found.select("doc_id", "base", "spans").collect()), key=str)


def letters():
    """Documents of which some have an address with its owner's name beside it."""
    r = random.Random(4)
    word = lambda: r.choice("the of and to in is it for on with as at by from".split())
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, fill(40)) for i in range(200)]
    rows += [(200 + i, f"{fill(9)} Quillon Abernathy {word()} q.abernathy@mail.example.com, {fill(5)}\n{fill(4)} Quillon {word()} +1 (017) 555-77{i:02} {fill(8)}.") for i in range(8)]
    rows += [(300, f"Quillon {fill(20)}"), (301, f"{fill(5)} 4952935900253052 {fill(5)}")]
    rows += [(400 + i, "Copied Zyx z@y.example.com Uvw") for i in range(5)]
    return rows


def test_terms_beside_identifiers_disclose_them(spark):
    rows = letters()
    found = spans_of(spark, rows)
    assert found == brute_spans(rows)
    by_id = dict((d, s) for d, _, s in found)
    assert by_id[200].count("term:") >= 2 and "term" not in by_id[300] and "term" not in by_id[301] and "term" not in by_id[400]


def test_odd_rows_have_spans(spark):
    rows = [(1, None), (None, "a@b.c 1.2.3.4"), (None, None), (2, ""), (2, "a@b.c"), (2, "a@b.c"), (3, "x" * 8_000 + "@" + "y" * 1000), (4, "1" * 10_000), (5, "é😀 a@b.co 😀 256.1.1.1 1.2.3.4.5.6.7.8 +1 23 45 67 89")]
    assert spans_of(spark, rows) == brute_spans(rows)
    assert spans_of(spark, []) == []


def test_identifiers_are_the_matches_of_their_forms():
    r = random.Random(8)
    for n in range(4000):
        text = "".join(r.choice("a@b.-1234+5 ()0é%" if n % 2 else "0123456789 -.+") for _ in range(r.randrange(60)))
        assert sanitisation.told([s[:3] for s in sanitisation.identifiers(text)]) == brute_base(text), text


def test_sanitised_text_tells_no_identifier(spark):
    rows = letters()
    found = {r["doc_id"]: r["text"] for r in sanitisation.sanitised(spark.createDataFrame([(*r, "", "") for r in rows], DOCS)).collect()}
    assert len(found) == len(rows) and found[0] == rows[0][1] and found[300] == dict(rows)[300]
    assert all("@" not in t and "555" not in t and ("Abernathy" not in t) for t in found.values()) and "[email .com]" in found[200]
    assert "Quillon" not in found[200]
