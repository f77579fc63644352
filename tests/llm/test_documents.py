"""Operators on texts against brute force, on small tables with every odd case."""

import binascii
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordrate.llm import bpe_fold, lpf_dedup, ngram_jaccard, pii_bootstrap, token_output, toxicity, vector_packing
from wordrate.llm.tokens import encoder

# extra columns whose names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component_id long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, -1, 0.5) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "One two"), (4, "ONE  two"), (5, "x" * 3000)]
    for i in range(6, n):
        if i % 4 == 0:
            w = out[r.randrange(3, i)][1].split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 4, 5, 6, 9, 30, 80])))))
    shared = " ".join(r.choice(vocab) for _ in range(40))
    out += [(n + j, f"{' '.join(r.choice(vocab) for _ in range(60))} {shared} {j}") for j in range(40)]
    out += [(n + 50, out[10][1]), (n + 51, out[10][1]), (12, out[12][1])]  # copies, and a repeated row
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in rows}
    changed = True
    links = [(i, j) for i, a in sets for j, b in sets if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return sorted((i, len(s), low[i]) for i, s in sets)


def test_jaccard_components(spark, monkeypatch):
    rows = corpus()
    got = ngram_jaccard.ngram_jaccard_components(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == expected_components(rows)


@pytest.mark.parametrize("percent", [50, 60, 70, 90, 95])
def test_jaccard_of_any_percent(spark, percent):
    """Also sets of one and two n-grams, which a low percentage links to others."""
    r = random.Random(percent)
    rows = [(i, " ".join(f"w{r.randrange(12)}" for _ in range(r.choice([1, 2, 3, 4, 6, 12, 30])))) for i in range(90)]
    rows += [(100 + i, " ".join(f"v{j}" for j in range(40 - i))) for i in range(20)]
    got = ngram_jaccard.ngram_jaccard_components(frame(spark, rows), k=1, percent=percent).collect()
    sets = {i: set(t.split()) for i, t in rows}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert sorted(tuple(x) for x in got) == sorted((i, len(s), low[i]) for i, s in sets.items())
    assert len(links) > 5


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those that the stages use inside come back as they were."""
    names = ["_gone", "gone", "id", "_id", "_key", "_spans", "spans", "hash", "text_hash", "own_0", "tkey", "_copy", "_g"]
    schema = SCHEMA + ", " + ", ".join(f"{n} long" for n in names)
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words), (2, words), (3, "mail a@b.org now"), (4, None), (4, "x " * 40), (None, "call +12 345 678 901")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, -1, 0.5, *range(20, 20 + len(names))) for i, t in rows], schema)
    one = ngram_jaccard.one_of_each(df)
    assert one.columns == df.columns
    kept = one.collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "4", "None"]
    out = pii_bootstrap.redacted(df)
    assert out.columns == df.columns and out.schema["n_chars"] == df.schema["n_chars"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert (3, "mail [EMAIL] now") in got and (None, "call [PHONE]") in got and got[3, "mail [EMAIL] now"].n_chars == 16 and len(got) == 6
    cut = lpf_dedup.without_later_copies(df)
    for r in [*kept, *got.values(), *cut.collect()]:
        assert [r[n] for n in names] == list(range(20, 20 + len(names))) and r.node == 7


def test_jaccard_long_lists_and_null_ids(spark, monkeypatch):
    """Lists of every length go by pivots; a group of near copies that are not all linked."""
    monkeypatch.setattr(ngram_jaccard, "LONG_LIST", 2)
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", 2)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"u{r.random()}"
        rows.append((i, " ".join(w)))
    got = ngram_jaccard.ngram_jaccard_components(frame(spark, rows + [(None, rows[0][1])])).collect()
    assert sorted(tuple(x) for x in got if x.doc_id is not None) == expected_components(rows)
    assert [tuple(x) for x in got if x.doc_id is None] == [(None, 56, None)]


def test_jaccard_boundary_and_light_sets(spark):
    """80 of 100 links, less does not; small sets meet by their 2-subsets."""
    assert ngram_jaccard.light_boundary({n: 1000 for n in range(4, 200)}, 80, 256) > 5
    a = [f"t{i}" for i in range(12)]
    rows = [(1, " ".join(a)), (2, " ".join(a + ["end"])), (3, " ".join(a[:9])), (4, " ".join(a + ["a", "b", "c"]))]
    got = ngram_jaccard.ngram_jaccard_components(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == expected_components(rows)


def test_one_of_each_keeps_the_smallest(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = ngram_jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in expected_components(rows) if i == c)


def expected_spans(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("limit", [100_000, 3])
def test_later_copies(spark, limit):
    """``limit`` 3: anchors with many classes are settled window by window."""
    rows = corpus(2)
    rows += [(200, "é" * 40 + "tail"), (201, "head" + "é" * 40), (202, "ab" * 100), (203, "b" + "ab" * 60)]
    got = lpf_dedup.remove_later_copies(frame(spark, rows), 50, limit).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got)
    assert got == expected_spans(rows)


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed):
    """The factors themselves, for strings of few letters and origins that repeat."""
    r = random.Random(seed)
    for _ in range(20):
        n = r.choice([8, 10, 16, 20, 50])
        strings = [bytes(r.choice(b"ab") if r.random() < 0.9 else r.choice(b"abc") for _ in range(n + r.randint(0, 30))) for _ in range(r.randint(1, 10))]
        strings += [strings[0], strings[-1] + strings[0]]
        origin = np.array([r.randint(0, 5) for _ in strings])
        off = np.cumsum([0] + [len(x) for x in strings])
        count = np.diff(off) - n + 1
        got = lpf_dedup.longest_previous_factors(np.frombuffer(b"".join(strings), np.uint8), off[:-1], count, origin, n)
        for s, o, factor in zip(*(x.tolist() for x in got)):
            own, best = strings[s][o:o + n], 0
            for j, other in enumerate(strings):
                if origin[j] < origin[s]:
                    for p in range(count[j]):
                        k = 0
                        while k < n and own[k] == other[p + k]:
                            k += 1
                        best = max(best, k)
            assert factor == best
    none = lpf_dedup.longest_previous_factors(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 50)
    assert [len(x) for x in none] == [0, 0, 0]


def test_later_copies_null_ids_and_texts_of_a_stage(spark):
    same = " ".join(f"word{i}" for i in range(30))
    docs = frame(spark, [(None, same), (5, same), (6, "é" + same), (7, None)])
    got = {(r.doc_id): r.n_removed for r in lpf_dedup.remove_later_copies(docs).collect()}
    assert got == {None: 0, 5: 0, 6: len(same), 7: 0}
    out = {r.doc_id: (r.text, r.n_chars) for r in lpf_dedup.without_later_copies(docs).collect()}
    assert out == {None: (same, len(same)), 5: (same, len(same)), 6: ("é", 1), 7: (None, 0)}


def test_bpe_round_trip_and_ids(spark):
    encode = encoder()
    rows = corpus(3) + [(300, "I'm 123's  \t\n ok <|endoftext|> ''s 's\n's  's"), (301, "　\x1c\x85naïve 漢字🙂"), (302, "y" * 500 + " " * 70)]
    got = bpe_fold.decode(bpe_fold.encode(frame(spark, rows))).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == sorted(
        (i, encode(t or "").astype("<u4").tobytes(), (t or "").encode()) for i, t in rows)


def test_bpe_fold_by_higher_order_functions(spark):
    encode = encoder()
    words = [" hello", " ofereanesin", "é", "x" * 30, "", " réeuxment", "123"]
    got = bpe_fold.encode_words(spark.createDataFrame([(w.encode(),) for w in words] + [(None,)], "word binary")).collect()
    assert [list(r.ids) for r in got] == [encode(w).tolist() for w in words] + [[]]


def test_tokenizers_give_the_same_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder()
    for _, text in corpus(4):
        assert t.encode(text or "", add_special_tokens=False).ids == encode(text or "").tolist()


def check_pieces(rows, got, capacity, end_id, max_docs=None, max_cost=None, width=None):
    encode = encoder()
    want = sorted((i, n) for i, n in ((i, np.append(encode(t or ""), end_id).astype("<u4").tobytes()) for i, t in rows))
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    width = width or capacity
    for i, ids in want:
        mine = sorted(((r.start, r.piece, r.length, r.ids_crc32) for r in by_doc[i]))
        n = len(ids) // 4
        cuts = [(0, n)] if n <= width else [(s, min(width, n)) for s in range(0, 0)]
        if n > width:
            first = n % width or width
            cuts = [(0, first)] + [(s, width) for s in range(first, n, width)]
        copies = sum(1 for j, x in want if (j, x) == (i, ids))
        assert mine == sorted([(s, k, m, binascii.crc32(ids[4 * s:4 * (s + m)])) for k, (s, m) in enumerate(cuts)] * copies)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        assert max_docs is None or len(parts) <= max_docs
        assert max_cost is None or sum(n * n for _, n in parts) <= max_cost
    return seqs


def test_vector_packing(spark):
    rows = corpus(5)
    got = vector_packing.pack_documents(frame(spark, rows), capacity=64).collect()
    seqs = check_pieces(rows, got, 64, 0)
    total = sum(n for p in seqs.values() for _, n in p)
    assert len(seqs) <= -(-total // 64) * 1.03 + 1
    got = vector_packing.pack_documents(frame(spark, rows), capacity=64, max_docs=2, max_cost=1600, by="dot", block=20).collect()
    check_pieces(rows, got, 64, 0, 2, 1600, 40)


def test_token_sequences(spark, tmp_path):
    rows = corpus(6)
    df = token_output.token_sequences(frame(spark, rows), capacity=64, window_tokens=2000)
    encode, segments = encoder(), {}
    seen = set()
    for r in df.collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert r.n_tokens == len(ids) == len(pos) <= 64 and r.n_segments == len(r.doc_ids) == len(r.cu_seqlens) - 1
        assert r.sequence_id not in seen
        seen.add(r.sequence_id)
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert pos[a:b].tolist() == list(range(b - a))
            segments.setdefault(r.doc_ids[k], []).append((r.doc_starts[k], ids[a:b].tolist()))
    for i, t in rows:
        want = encode(t or "").tolist() + [50256]
        got = sorted(segments[i])
        copies = sum(1 for j, _ in rows if j == i)
        assert [x for _, s in got for x in s] == want if copies == 1 else sum(len(s) for _, s in got) == copies * len(want)
    token_output.write_matrix(df, str(tmp_path / "m"), 64)
    assert {len(r.ids) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {128}


def test_capacity_tree_is_best_fit():
    r = random.Random(1)
    lengths = [r.randint(1, 64) for _ in range(500)]
    left, want = [], []
    for i in sorted(range(500), key=lambda j: -lengths[j]):
        fit = [(room, b) for b, room in enumerate(left) if room >= lengths[i]]
        if fit:
            b = min(fit)[1]
        else:
            b = len(left)
            left.append(64)
        left[b] -= lengths[i]
        want.append(left[b])
    bins = token_output.best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins) and len(bins) == len(left)


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def base_by_rule(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d)
                    or k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


ODD = [None, "", "é a@b@c.de x.y+z@m-1.example.com.", "@a.b c@.d e@f..g", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
       "4111 1111-1111 1111 and 4111111111111112, 12345678901234567890123", "+1 (017) 555-7713 +12345 +1.2.3.4.5.6.7.8.9.0.1 ++44 20 7946 0958",
       "a@b.c@d.e", "9" * 5000 + " 4111111111111111", "漢字 q@r.st 10.0.0.1"]


def test_personal_data_base(spark):
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("ab1 90.@+-()") for _ in range(200)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "z@y.xx"), (3, texts[3])]
    got = pii_bootstrap.personal_data(frame(spark, rows)).collect()
    want = [(i, base_by_rule(t)) for i, t in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(x.doc_id, [tuple(s) for s in x.base]) for x in got], key=key) == sorted(want, key=key)
    assert all(set(x.base) <= set(x.spans) for x in got)


def test_personal_data_discovers_by_context(spark):
    rows = [(i, f"Please write to mailbox u{i}@example.com today.") for i in range(20)]
    rows += [(50, "Please write to mailbox u99(at)example today."), (51, "Version 12345-x is out, see chapter 77 of it.")]
    docs = frame(spark, rows)
    got = {r.doc_id: [docs_text[s.start:s.end] for s in r.spans] for r in pii_bootstrap.personal_data(docs).collect() for docs_text in [dict(rows)[r.doc_id]]}
    assert got[50] == ["u99(at)example"] and got[51] == [] and got[3] == ["u3@example.com"]
    out = {r.doc_id: (r.text, r.n_chars) for r in pii_bootstrap.redacted(docs).collect()}
    assert out[3] == ("Please write to mailbox [EMAIL] today.", 38) and out[50][0] == "Please write to mailbox [EMAIL] today."
    assert out[51][0] == rows[-1][1]


def graph_by_hand(texts, rounds=3, prior=3.0):
    """(pattern, kind) -> (confidence, seeds), the rounds of the pattern-instance graph in plain Python."""
    edge = {}
    for t in texts:
        for kind, _, _, value, left, right in pii_bootstrap.occurrences(t):
            if value:
                for p in [f"L:{left}"] * (left != "") + [f"R:{right}"] * (right != "") + [f"B:{left} {right}"] * (left != "" and right != ""):
                    edge[p, kind, value] = edge.get((p, kind, value), 0) + 1
    total = {}
    for (p, _, _), n in edge.items():
        total[p] = total.get(p, 0) + n
    score, conf = {}, {}
    for _ in range(rounds):
        weight, seeds = {}, {}
        for (p, kind, value), n in edge.items():
            if kind >= 0:
                weight[p, kind] = weight.get((p, kind), 0) + n
                seeds[p, kind] = seeds.get((p, kind), 0) + 1
            else:
                for k in range(4):
                    if (value, k) in score:
                        weight[p, k] = weight.get((p, k), 0) + n * score[value, k]
        conf = {x: (w / (total[x[0]] + prior), seeds.get(x, 0)) for x, w in weight.items()}
        every, part = {}, {}
        for (p, kind, value), n in edge.items():
            if kind < 0:
                every[value] = every.get(value, 0) + n
                for k in range(4):
                    if (p, k) in conf:
                        part[value, k] = part.get((value, k), 0) + n * conf[p, k][0]
        score = {(v, k): min(w / every[v], 0.999) for (v, k), w in part.items()}
    return conf


def test_pattern_graph_equals_plain_rounds(spark):
    """Contexts of several kinds, shared by seeds and by other strings, over one to four rounds."""
    r = random.Random(8)
    lead = ["mailbox", "host", "call", "see", "from", "ticket"]
    texts = []
    for i in range(160):
        what = r.choice([f"u{i}@a{i % 7}.org", f"10.0.{i % 9}.{i}", f"+44 20 7946 0{i:03d}", f"u{i % 30}(at)a", f"host-{i % 20}x", f"77{i % 40}-b"])
        texts.append(f"The {r.choice(lead)} {what} {r.choice(['now', 'today', 'or', ''])}.")
    for rounds in (1, 2, 4):
        rows = [o for t in texts for o in pii_bootstrap.occurrences(t)]
        occ = spark.createDataFrame(rows, "kind int, start int, end int, value string, left string, right string")
        got = {(x.pattern, x.kind): (pytest.approx(x.confidence, rel=1e-9), x.seeds) for x in pii_bootstrap.patterns(occ, rounds).collect()}
        want = graph_by_hand(texts, rounds)
        assert got == want and len(got) > 20
    found = {p for p, (c, n) in graph_by_hand(texts).items() if c >= 0.05 and n >= 5}
    spans = pii_bootstrap.personal_data(frame(spark, list(enumerate(texts))), min_confidence=0.05).collect()
    for x in spans:  # a discovered string stands in a pattern that counts, and all of them are found
        t, more = texts[x.doc_id], {(s.start, s.end) for s in x.spans} - {(s.start, s.end) for s in x.base}
        want = {(s, e) for k, s, e, v, a, b in pii_bootstrap.occurrences(t) if k < 0 and any((p, j) in found for j in range(4) for p in (f"L:{a}", f"R:{b}", f"B:{a} {b}"))}
        assert more == want
    assert any(len(x.spans) > len(x.base) for x in spans)


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_takes_the_best_open_bin(by):
    """Every choice against a search through all open bins, with capacities that bind."""
    r = random.Random(6)
    for capacity, max_docs, max_cost in [(100, 100, 1e4), (100, 5, 1e4), (100, 6, 4000.0), (64, 3, 64.0 ** 2)]:
        width = min(capacity, int(max_cost ** 0.5))
        length = np.array([r.randint(1, r.choice([4, width // 2, width])) for _ in range(300)])
        got = vector_packing.best_fit(length, capacity, max_docs, max_cost, by)
        caps, left, want = (capacity, max_docs, max_cost), [], {}
        weight = (1.0, float(max_docs < capacity), float(max_cost < capacity ** 2))
        for i in sorted(range(len(length)), key=lambda i: -length[i]):
            need = (length[i], 1, float(length[i]) ** 2)
            best, at = None, len(left)
            for k, free in enumerate(left):
                if all(f >= n for f, n in zip(free, need)):
                    rest = [(f - n) / c for f, n, c in zip(free, need, caps)]
                    value = -sum(w * x * x for w, x in zip(weight, rest)) if by == "norm" else sum(w * x * n / c for w, x, n, c in zip(weight, rest, need, caps))
                    if best is None or value > best + 1e-12:
                        best, at = value, k
            if at == len(left):
                left.append(caps)
            left[at] = tuple(f - n for f, n in zip(left[at], need))
            want[i] = at
        assert got.tolist() == [want[i] for i in range(len(length))]


def test_toxicity_held_out(spark):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(["scumbag", "moronic", "idiotish"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "idiotish"), (3, rows[3][1])]
    labels = spark.createDataFrame(marks + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is not None and binascii.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    truth = dict(marks)
    held = [(x.predicted, truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == sorted((x.doc_id is None, x.doc_id or 0) for x in got if not x.predicted)


def test_toxicity_scores_by_hand():
    """A text's score from its distinct n-grams, one by one, for a model of random weights."""
    r = random.Random(12)
    mask = (1 << 64) - 1

    def slots(text):
        data = b" " + bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode()) + b" "
        out = set()
        for size, mult in ((4, 0x2545F4914F6CDD1D), (6, 0xD6E8FEB86659FD93), (8, 0xA0761D6478BD642F)):
            for k in range(len(data) - size + 1):
                g = int.from_bytes(data[k:k + size], "big")
                if size == 8:
                    g = ((g >> 32) * 0x9E3779B97F4A7C15 + (g & 0xFFFFFFFF) * 0xC2B2AE3D27D4EB4F) & mask
                out.add((((g * mult) & mask) >> (64 - toxicity.BITS)) ^ (size * 0x1234 if size > 4 else 0))
        return out
    texts = ["", "a", "Some Words, 12 of them!", "é漢字 ÀB", "x" * 400, "abc abc abc abc", None] + ["".join(r.choice("abcdE 1é.") for _ in range(r.randint(0, 60))) for _ in range(60)]
    weights = np.where(np.random.default_rng(1).random(1 << toxicity.BITS) < 0.5, np.random.default_rng(2).normal(size=1 << toxicity.BITS), 0)
    model = toxicity.Model(weights, -0.3)
    got = model.score(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), 0)
    for t, score in zip(texts, got):
        z = sum(float(model.weights[x]) for x in slots(t or "")) - 0.3
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-9)


def test_toxicity_never_learns_from_other_labels(spark):
    """Held-out labels and labels of no document change nothing, nor do they use up the sample."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(30)) + (" scumbag" if i % 4 == 0 else "")) for i in range(400)]
    marks = [(i, int(i % 4 == 0)) for i in range(400)]

    def scores(marks):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        return {x.doc_id: x.score for x in toxicity.score_documents(frame(spark, rows), labels, fit_rows=150).collect()}

    held = {i for i, _ in rows if binascii.crc32(str(i).encode()) % 3 == 1}
    want = scores(marks)
    assert want[4] > 0.7 > want[1]
    for other in ([(i, 1 - t if i in held else t) for i, t in marks], marks + [(i, 1) for i in range(1000, 9000)]):
        assert scores(other) == pytest.approx(want, abs=1e-6)


def test_toxicity_weighs_every_telling_ngram(spark):
    """More than 8,000 n-grams tell the classes apart here; none of the 20,000 best is left out."""
    r = random.Random(6)
    words = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(2000))
    texts = [words(), words()]
    docs = frame(spark, [(i, texts[i % 2]) for i in range(40)])
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert np.count_nonzero(model.weights) == 20_000


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(frame(spark, [(1, "a"), (2, None)]), labels).collect()} == {0.5}


def test_empty_tables(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (ngram_jaccard.ngram_jaccard_components(none), lpf_dedup.remove_later_copies(none), bpe_fold.decode(bpe_fold.encode(none)),
                vector_packing.pack_documents(none), token_output.token_sequences(none), toxicity.score_documents(none, labels),
                pii_bootstrap.personal_data(none), ngram_jaccard.one_of_each(none), lpf_dedup.without_later_copies(none), pii_bootstrap.redacted(none)):
        assert out.count() == 0


def _peak(task, batches):
    """MB that a task's body holds at most beyond its input, and its rows."""
    import tracemalloc
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in task(batches))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def _long_texts():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50_000, 500)) for _ in range(900)]
    return pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(range(900)), pa.array(texts)], names=["doc_id", "tkey", "text"])


def test_memory_of_repeated_passages():
    """Texts are hashed in small pieces, anchors are sent together from many, and each is sent
    twice at most: what a task holds does not follow the size of its batches."""
    class Marked:
        value = np.full(1 << (lpf_dedup.BITMAP_BITS - 3), 255, np.uint8)

    batch = _long_texts()
    for task in (lpf_dedup._anchors(50, 8), lpf_dedup._marked(50, Marked)):
        mb, rows = _peak(task, [batch])
        assert rows and mb < 60
    # equal texts in different batches: every anchor still twice, in a row for each range
    rows = [r for b in lpf_dedup._anchors(50, 8)([batch.slice(0, 3)] * 4) for r in b.to_pylist()]
    assert len(rows) == 8
    for r in rows:
        _, n = np.unique(lpf_dedup._long(r["hashes"]), return_counts=True)
        assert (n == 2).all()


def test_memory_of_ngram_sets():
    class Classes:
        value = np.zeros(1 << ngram_jaccard.SKETCH_BITS, np.uint8)

    batch = _long_texts().drop_columns(["tkey"])
    mb, rows = _peak(ngram_jaccard._postings(5, 80, Classes, 24), [batch])
    assert rows and mb < 15


def test_texts_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"{i} " + "x" * 100_000) for i in range(200)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
    try:
        spark.conf.set(key, "64m")
        lpf_dedup.remove_later_copies(docs).count()
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 5_000_000
        spark.conf.set(key, "1m")  # a session that asks for less keeps it
        ngram_jaccard.ngram_jaccard_components(docs).count()
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
