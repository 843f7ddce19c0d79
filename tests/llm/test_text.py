"""SimHash, toxicity, chat, pieces, token files, licenses and embeddings against brute force or exact round trips."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
import xxhash
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lading.llm import chat, embeddings, graph, licenses, runs, sentencepiece, simhash, tokens, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " \n", "one", "The quick brown fox jumps over the lazy dog", "the QUICK brown fox jumps over the lazy dog", "É é ß naïve İ ς", "w" * 4000, " ".join(f"w{i}" for i in range(2500)), "a  b\tc\n\nd   ", "<|endoftext|> it's 12,3 don't", "漢字 😀 ab", "x y " * 700]


def docs(spark, texts):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, 1, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, fp int, node string, part string")


def components(n, linked):
    label = list(range(n))
    while True:
        new = [min(label[j] for j in range(n) if i == j or linked(i, j)) for i in range(n)]
        if new == label:
            return label
        label = new


def test_components_in_one_task_and_in_many(spark):
    """A hub, a chain, repeats, loops, nulls and negative nodes, reduced in one task or dealt over many."""
    rng = np.random.default_rng(3)
    edges = [(-50, i) for i in range(-49, -20)] + [(i, i + 1) for i in range(100, 140)] + [(int(a), int(b)) for a, b in rng.integers(200, 320, (70, 2))]
    edges += edges[:20] + [(7, 7), (None, 8), (9, None)]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = sorted({n for edge in real for n in edge})
    linked = {(x, y) for a, b in real for x, y in ((a, b), (b, a))}
    want = dict(zip(nodes, (nodes[k] for k in components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in linked)), strict=True))
    rows = spark.createDataFrame(edges, "a long, b long")
    for a_task in (1_000_000, 25):
        got = graph.connected_components(rows, a_task).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert graph.connected_components(rows.limit(0)).count() == 0


def slow_print(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    cut = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(c.encode(), 42) for c in cut]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark):
    base = [f"word{i}" for i in range(300)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 300, 12)]
    texts = TEXTS + near + near[:4] + [" ".join(base)]
    got = {r.doc_id: r for r in simhash.simhash_report(docs(spark, texts)).collect()}
    want = [slow_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{w:016x}" for w in want]
    assert [got[i].component_id for i in range(len(texts))] == components(len(texts), lambda i, j: (want[i] ^ want[j]).bit_count() <= 4)


def test_links_in_a_dense_group(spark, monkeypatch):
    """A group larger than a cell, around one fingerprint, beside random ones."""
    monkeypatch.setattr(simhash, "CELL", 50)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)} | {0x1234_5678_9ABC_DEF0 ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (250, 3))}
    fps = sorted(fps)
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, first long")
    found = simhash.links(rows).collect()
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[max(top(r.a), top(r.b))] = min(top(r.a), top(r.b))
    want = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [top(f) for f in fps] == [fps[k] for k in want]
    assert len(found) < 12 * len(fps)


def test_plans_keep_the_pigeonhole_principle():
    rng = np.random.default_rng(1)
    for n in (10, 10**4, 10**6, 10**9):
        parts = simhash.allocate(rng.integers(1, 9, (16, 16)), n, 4)
        assert sum(t + 1 for _, _, t in parts) == 5
        assert all(a < b for a, b, _ in parts)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=80))
def test_forest(pairs):
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    x, y = runs.forest(a, b)
    label = lambda ps: components(41, lambda i, j: (i, j) in ps or (j, i) in ps)
    assert label(set(zip(x.tolist(), y.tolist(), strict=True))) == label(set(pairs))
    assert len(x) <= 40


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "labore", "magna"]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 5 == 0:
            words[int(rng.integers(40))] = ["vilescum", "hatefool"][i // 5 % 2]
        texts.append(" ".join(words))
        labels.append((i, int(i % 5 == 0)))
    texts += [None, "", "x" * 30000]
    marks = spark.createDataFrame([*labels, (399, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs(spark, texts), marks).collect()}
    assert len(got) == 403
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.95
    only = toxicity.toxicity_report(docs(spark, texts[:5]), marks.where("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in only)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\\<>|/s[]INSTY_im\n ", max_size=60))
def test_escapes_go_back(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", out)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>\\b"), (1, 1, "assistant", "again"), (2, 0, None, None), (2, None, "system", ""), (3, 0, "assistant", "é" * 5000), (None, 0, "odd\nrole", "x")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.chat_report(table).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r.conv_id for r in chat.chat_report(table.limit(0)).collect()] == [-7]


def test_layouts(spark):
    records = ['{"instruction":"a","output":"b"}', '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":null}]}', '{"other":1}', "no json", None, '{"instruction":"a","input":"c","output":"b"}', '{"prompt":"p","response":"r","system":""}']
    table = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    got = {r.id: (r.mapped, [tuple(t) for t in r.turns]) for r in chat.json_turns(table, "record", "id").collect()}
    assert got[0] == (True, [("user", "a"), ("assistant", "b")])
    assert got[1] == (True, [("user", "x"), ("assistant", "")])
    assert [got[i] for i in (2, 3, 4)] == [(False, [])] * 3
    assert got[5][1][0] == ("user", "a\n\nc")
    assert got[6][1] == [("user", "p"), ("assistant", "r")]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.load(PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefghinrst \n.,ÀéＡ漢😀\t\r;", max_size=400))
def test_pieces_are_the_library_s(text):
    model = sentencepiece.load(PIECES) if not hasattr(test_pieces_are_the_library_s, "m") else test_pieces_are_the_library_s.m
    test_pieces_are_the_library_s.m = model
    ids = sentencepiece.Encoder(model, {})(text).tolist()
    assert ids == library.SentencePieceProcessor(model_file=PIECES).encode(text)
    assert sentencepiece.decode(model, ids) == text


def test_lattice(spark, model):
    units = ["▁" + w for w in ("the", "international", "unbelievably", "x", "漢é😀", "zzzz", "ab" * 25, "Ärger")] + ["plain", "\n", "▁"]
    got = {r.unit: r.ids for r in sentencepiece.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    for u in units:
        assert [j for i in got[u] for j in ([i] if i >= 0 else [model.bytes_from + b for b in u[-1 - i].encode()])] == sentencepiece.encode_unit(model, u)


def test_piece_report(spark, model):
    lib = library.SentencePieceProcessor(model_file=PIECES)
    table = docs(spark, TEXTS)
    for r in sentencepiece.piece_report(table, PIECES).collect():
        text = TEXTS[r.doc_id] or ""
        assert r.n_pieces == len(lib.encode(text))
        assert r.ids_crc32 == zlib.crc32(np.array(lib.encode(text), "<u4").tobytes())
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = sentencepiece.decoded(sentencepiece.encoded(table, PIECES), PIECES)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert sentencepiece.piece_report(table.limit(0), PIECES).count() == 0


def test_token_files(spark):
    lib = Tokenizer.from_file(WORDS)
    rows = [*enumerate(TEXTS), (3, "again"), (None, "no id"), (-5, "first")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_report(table, WORDS).collect())
    at, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.token_report(table.limit(0), WORDS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1)), max_size=1500))
def test_random_access(ids):
    file = tokens.TokenFile(tokens.pack([7], np.array([0, len(ids)]), np.array(ids, np.uint32)))
    assert [file[i] for i in range(0, len(ids), 7)] == ids[::7]
    a, b = len(ids) // 3, len(ids) * 2 // 3
    assert file.slice(a, b).tolist() == ids[a:b] and file.slice(0, len(ids)).tolist() == ids


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcAZéÀß'.,0 \n\t<|>endoftxİς́", max_size=200))
def test_words_are_the_library_s(text):
    encode = tokens._encoder(WORDS)
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_licenses(spark):
    rng = np.random.default_rng(2)
    texts = [" x" * k + " " + n + " y" * k for _, n in licenses.TEMPLATES for k in (0, 3, 300)] + [n.replace(" the ", " THE  ") for _, n in licenses.TEMPLATES] + TEXTS
    for _, n in licenses.TEMPLATES:
        words = n.split()
        words[int(rng.integers(len(words)))] = "changed"
        texts.append(" ".join(words))
    known = licenses.Templates(licenses.TEMPLATES)
    got = collections.defaultdict(set)
    for r in licenses.license_report(docs(spark, texts)).collect():
        got[r.doc_id].add(r.license)
        assert r.containment >= licenses.CONTAINED and r.first_word < r.after_word
    for i, text in enumerate(texts):
        words = licenses.words(text or "")
        own = {b" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
        assert got[i] == {known.names[t] for t in range(len(known.names)) if len(own & known.exact[t]) / len(known.exact[t]) >= licenses.CONTAINED}
    assert licenses.license_report(docs(spark, [])).count() == 0


def test_licenses_with_inserted_passages():
    known = licenses.Templates(licenses.TEMPLATES)
    for t, (name, notice) in enumerate(licenses.TEMPLATES):
        words = notice.split()
        for gap in (30, 400, 5000):
            half = len(words) // 2
            text = " ".join(["start", *words[:half], *(f"x{i}" for i in range(gap)), *words[half:], "end"])
            own = licenses.words(text)
            own = {b" ".join(own[k : k + 5]) for k in range(len(own) - 4)}
            share = len(own & known.exact[t]) / len(known.exact[t])
            found = [{m[0]: m for m in ms} for ms in licenses.matches(["", text, "tail"], known)]
            assert not found[0] and not found[2] and (name in found[1]) == (share >= licenses.CONTAINED)
            if gap == 5000 and name in found[1] and found[1][name][1] == share:
                assert found[1][name][2:] == (1, len(licenses.words(notice)) + gap + 1)


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rng = np.random.default_rng(9)
    center = rng.normal(size=64)
    rows += [(10_000 + i, (center + rng.normal(size=64) * 0.12).tolist()) for i in range(120)] + [(20_000 + i, center.tolist()) for i in range(30)]
    odd = [(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [1.0, 2.0]), (-5, [None] * 64), (-6, []), (-7, [float("inf")] * 64)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, node string")
    got = {r.vec_id: r for r in embeddings.linked(table).collect()}
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    want = near.sum(axis=1) - 1
    have = np.array([got[i].n_links for i, _ in rows])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert all(got[i].kept == (got[i].component_id == i) for i, _ in rows)
    assert embeddings.linked(table.limit(0)).count() == 0


def test_embeddings_of_each_length(spark):
    rng = np.random.default_rng(6)
    rows = [(100 * d + i, v.tolist()) for d in (3, 8, 16) for i, v in enumerate(np.repeat(rng.normal(size=(d, d)), 3, axis=0))] + [(9, [1.0]), (8, [0.0])]
    got = {r.vec_id: r for r in embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    for i, v in rows:
        same = [j for j, w in rows if len(v) == len(w) and any(v) and any(w) and np.dot(v, w) >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert got[i].n_links == max(0, len(same) - 1)
        assert got[i].component_id <= min([*same, i])


def test_embeddings_in_small_cells(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 16)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    small = sorted(map(tuple, embeddings.linked(table).collect()))
    monkeypatch.undo()
    assert small == sorted(map(tuple, embeddings.linked(table).collect()))


@pytest.mark.parametrize(("dim", "kind"), [(4, "float"), (16, "double"), (64, "float")])
def test_embeddings_over_many_lists(spark, monkeypatch, dim, kind):
    """Over a hundred lists: links are symmetric, none is false, and all are found where the reach is lossless."""
    monkeypatch.setattr(embeddings, "LIST_ROWS", 24)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(2600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(1000, dim))
    side -= (side * x[:1000]).sum(axis=1, keepdims=True) * x[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9499, 0.97, 1000)[:, None]
    x = np.concatenate([x, cos * x[:1000] + np.sqrt(1 - cos**2) * side])
    x = x.astype(np.float32 if kind == "float" else np.float64).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    assert embeddings.lists_for(len(x)) > 100
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    want = near.sum(axis=1) - 1
    for reach in (None, embeddings.EXACT):
        got = np.array([r.n_links for r in sorted(embeddings.linked(table, reach=reach).collect())])
        assert (got <= want).all() and got.sum() % 2 == 0
        assert got.sum() >= (1 if reach or dim < 32 else 0.99) * want.sum()


def test_toxicity_is_brute_force(spark):
    """Scores as plain Python counts, scales and learns them, from the rows that may be learned from."""
    import math

    rng = np.random.default_rng(3)
    bad, good = ["vile", "stupid", "hate"], ["kind", "lovely", "river"]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good, 4)), int(i % 3 == 0)) for i in range(60)]
    docs_ = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, "zzz"), (None, "vile"), (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = {(r.doc_id, r.held_out): r.score for r in toxicity.toxicity_report(docs_, labels).collect() if r.doc_id != 7}

    def cells(text):
        code = [ord(c) for c in f" {text.lower()} "]
        out = set()
        for k in toxicity.LENGTHS:
            for i in range(len(code) - k + 1):
                h = 0
                for c in code[i : i + k]:
                    h = (h * 1_000_003 + c) * 0x2545F4914F6CDD1D % 2**64
                out.add(h * 0x9E3779B97F4A7C15 % 2**64 >> 44)
        return out

    learn = [(cells(t), k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2 and i != 7]
    seven = next(t for i, t, _ in rows if i == 7)
    if zlib.crc32(b"7") % 4 != 2:
        learn.append((cells(min(seven, "zzz")), 0))
    share = sum(k for _, k in learn) / len(learn)
    count = [collections.Counter(c for cs, k in learn if k == want for c in cs) for want in (0, 1)]
    seen = set(count[0]) | set(count[1])
    total = [sum(c.values()) + toxicity.CELLS for c in count]
    ratio = {c: math.log((count[1][c] + 1) / total[1]) - math.log((count[0][c] + 1) / total[0]) for c in seen}
    used = {c for c in seen if count[0][c] + count[1][c] >= toxicity.LEAST_ROWS and abs(ratio[c]) >= toxicity.LEAST_RATIO}
    n = [sum(k == want for _, k in learn) for want in (0, 1)]
    w, b = dict.fromkeys(used, 0.0), math.log(share / (1 - share))
    m, v, mb, vb = dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        g, gb = {c: toxicity.PENALTY * w[c] for c in used}, 0.0
        for cs, k in learn:
            off = (share if k else 1 - share) / n[k] * (1 / (1 + math.exp(-(b + sum(w[c] * ratio[c] for c in cs & used)))) - k)
            gb += off
            for c in cs & used:
                g[c] += off * ratio[c]
        for c in used:
            m[c], v[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * v[c] + 0.001 * g[c] ** 2
            w[c] -= toxicity.RATE * (m[c] / (1 - 0.9**step)) / (math.sqrt(v[c] / (1 - 0.999**step)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= toxicity.RATE * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    for i, t in [(i, t) for i, t, _ in rows if i != 7] + [(500, ""), (501, "")]:
        want = 1 / (1 + math.exp(-(b + sum(w[c] * ratio[c] for c in cells(t) & used))))
        assert abs(got[i, zlib.crc32(str(i).encode()) % 4 == 2] - want) < 1e-4
    none = toxicity.toxicity_report(docs_, labels.limit(0)).collect()
    assert len(none) == 64 and len({r.score for r in none}) == 1
    assert toxicity.toxicity_report(docs_.limit(0), labels).count() == 0


def test_learning_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHARS_A_CLASS", 100)
    docs_ = spark.createDataFrame([(i, "vile " * 5 if i % 2 else "kind " * 5) for i in range(40)] + [(41, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, toxic int")
    once, again = ([tuple(r) for r in toxicity.toxicity_report(docs_.repartition(n), labels).orderBy("doc_id").collect()] for n in (1, 5))
    assert once == again and len(once) == 41


def test_best_paths(spark):
    """Viterbi by the fold against all ways to cut a word."""
    rng = np.random.default_rng(2)
    pieces = {p: float(-rng.integers(1, 90)) / 8 for p in ("a", "b", "ab", "ba", "aab", "abb", "bba", "c", "cab")}
    ids = {p: k for k, p in enumerate(pieces)}
    units = ["".join(rng.choice(list("abcx"), n)) for n in range(1, 11) for _ in range(4)]

    def score(path):
        return sum(pieces.get(p, -20.0) for p in path)

    def ways(u):
        return [[]] if not u else [[u[:n], *rest] for n in range(1, min(3, len(u)) + 1) if u[:n] in pieces or n == 1 for rest in ways(u[n:])]

    got = {r.unit: r.ids for r in sentencepiece.best_paths(spark.createDataFrame([(u,) for u in set(units)], "unit string"), pieces, ids, -20.0).collect()}
    back = {k: p for p, k in ids.items()}
    for u in units:
        path = [back[i] if i >= 0 else u[-1 - i] for i in got[u]]
        assert "".join(path) == u and abs(score(path) - max(map(score, ways(u)))) < 1e-9


def test_a_column_named_ids_gives_way(spark):
    table = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, ids string")
    assert sentencepiece.encoded(table, PIECES).columns == ["doc_id", "ids"]


def test_rows_of_one_id_in_many_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "FILE_TOKENS", 50)
    table = spark.createDataFrame([(5, f"word {i} and more") for i in range(60)] + [(None, "none")] * 3 + [(1, "one")], "doc_id long, text string")
    files = tokens.write_tokens(table, WORDS, 1, f"file://{tmp_path}/t")
    assert files.count() > 4 and files.where("tokens > 50").isEmpty()
    rows = sorted(tokens.read_tokens(files, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 3 + [1] + [5] * 60
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))


def test_licenses_from_a_table(spark):
    table = spark.createDataFrame([("Own-1.0", "you may do with this work as you please"), ("Short", "too short"), (None, "a b c d e f"), ("Own-1.0", "you may do with this work as you please")], "license string, text string")
    rows = licenses.license_report(spark.createDataFrame([(1, "Note: you may do with this work as you please."), (2, "nothing")], "doc_id long, text string"), table).collect()
    assert [(r.doc_id, r.license, r.containment) for r in rows] == [(1, "Own-1.0", 1.0)]


def test_repeated_rows(spark):
    """One id with two texts, and rows that repeat, in fingerprints and embeddings."""
    rows = [(3, "one two three four five"), (3, "quite another text here now"), (3, "one two three four five"), (1, "quite another text here now"), (None, "one two three four five")]
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.simhash_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(3, 3): 2, (3, 1): 1, (1, 1): 1, (None, 3): 1}
    table = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.linked(table).collect()) == [(2, 2, 2), (5, 0, 5), (5, 2, 2), (5, 2, 2)]
