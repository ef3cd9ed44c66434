"""Operators on small cases with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import dom_model, hash_tree, importance, licenses, line_frequency, line_templates, minhash, mixing, projection
from gridloom.llm import sentencepiece_model as sp
from gridloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def table(spark, texts, sources=None):
    rows = [(i if i != 3 else None, t, "en", (sources or ["a", "b", None])[i % len(sources or "abc")], len(t or ""), "old", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [None, "", " \t\n ", "x", "one two three four five six", "one two three four five six", LONG, LONG + " end", "A b\nA b\nc d e f g h i\n", "é ß 12 ab12 #*|", "café x y\x0bz\r\nq"]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_base_counts(spark):
    r = {(x.doc_id, x.text): x for x in line_frequency.quality_rules(table(spark, TEXTS)).collect()}
    assert len(r) == len(TEXTS)
    for (_, t), x in r.items():
        ws = words(t)
        win = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        hit = {p for i, w in enumerate(win) if win.count(w) > 1 for p in range(i, i + 3)} if len(win) < 5000 else set()
        lines = [li for li in (t or "").split("\n") if words(li)]
        assert (x.n_words, x.word_chars, x.n_repeat_words) == (len(ws), sum(map(len, ws)), len(hit))
        assert x.n_dup_lines == len(lines) - len(set(lines)) and x.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert x.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws))
    assert line_frequency.quality_rules(empty(spark)).count() == 0


def test_frequent_lines_go(spark):
    own = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    texts = [f"{own(i, 70)}\n  Read   MORE here\tnow \n" for i in range(30)] + ["read more here now\n" * 3 + own(99, 2)] + [f"read more here now\n{own(5, 60)}"] * 5
    r = line_frequency.quality_rules(table(spark, texts, ["h"]), min_docs=10).collect()
    assert all(x.n_lines_removed == 1 and x.kept and "MORE" not in x.clean_text for x in r if x.n_words > 70)
    assert all(not x.kept for x in r if x.n_words < 50)


def test_line_templates(spark):
    passage = " ".join(f"p{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))
    edited = passage.replace("pek", "changed")
    texts = [f"first text of its own kind\n{passage}", f"{edited}\nsecond text of another kind here", f"third one\n{passage}\nnothing else to see at all", None, "", "error 17 at line 5 of file a", "error 99 at line 8 of file a", f"first text of its own kind\n{passage}"]
    r = line_templates.line_dedup(table(spark, texts)).collect()
    by = {x.doc_id: x for x in r}
    assert by[0].clean_text == texts[0] and by[7].clean_text == texts[0]
    assert by[1].clean_text == "second text of another kind here" and by[2].clean_text == "third one\nnothing else to see at all"
    assert by[5].clean_text == texts[5] and by[6].clean_text == "" and by[4].clean_text == "" and by[None].clean_text is None
    assert line_templates.line_dedup(empty(spark)).count() == 0


def test_shards(spark):
    d = table(spark, TEXTS + ["t"] * 300)
    r = hash_tree.shards(d, 5).collect()
    assert len(r) == len(TEXTS) + 300
    for s in range(5):
        assert sorted(x.slot for x in r if x.shard == s) == list(range(sum(x.shard == s for x in r)))
    assert all(x.grown_shard in (x.shard, 5) for x in r) and any(x.grown_shard == 5 for x in r)
    assert sorted((x.size, x.text_crc32) for x in r) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in TEXTS + ["t"] * 300)
    assert hash_tree.shards(empty(spark)).count() == 0


def test_weights_move_only_into_what_grows(spark):
    from pyspark.sql import functions as F

    k = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    r = k.select(hash_tree.shard_of(F.col("k"), 8).alias("a"), hash_tree.shard_of(F.col("k"), 8, {5: 3.0}).alias("b")).collect()
    assert all(x.a == x.b or x.b == 5 for x in r)
    assert 0.25 < sum(x.b == 5 for x in r) / 4000 < 0.35


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got[9] == 3 and got[5] == 3 and got[21] == 20 and all(got[100 + i] == 100 for i in range(41))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    r = np.random.default_rng(3)
    base = [" ".join(f"t{r.integers(400)}" for _ in range(60 + 5 * k)) for k in range(6)]
    texts = list(TEXTS)
    for b in base:
        texts.append(b)
        for _ in range(6):
            ws = b.split()
            for _ in range(r.integers(0, 4)):
                ws[r.integers(len(ws))] = f"e{r.integers(10**6)}"
            texts.append(" ".join(ws).upper())
    d = table(spark, texts)

    def shingles(t):
        ws = (t or "").encode().lower().split()
        return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()

    ids = [i for i in range(len(texts)) if i != 3]
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {x.doc_id: x for x in minhash.near_duplicates(d, width=width).collect()}
    assert got[None].component_id is None and got[None].kept
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_pruning_bound():
    least = minhash.least_matches(32, 160, 0.8, 1e-6)
    assert 0 < least[32] < 26 and least[160] / 160 < 0.8 and least[160] > least[32]


def test_minhash_large_buckets(spark, monkeypatch):
    """Buckets that go through blocks of several members, with pairs on both sides of the threshold, against all pairs."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 3)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(200)]
    texts = []
    for i in range(90):
        ws = list(base)
        for p in rng.choice(200, 4 + i % 14, replace=False):
            ws[p] = f"v{i % 30}_{p}" if i % 3 else f"v{p}"
        texts.append(" ".join(ws))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = [x if c == y else c for c in comp]
    assert 2 < len(set(comp)) < 80
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, width=2).collect()}
    assert got == dict(enumerate(comp))


def test_mixing(spark):
    d = table(spark, TEXTS + [f"m{i} " * (i % 40 + 1) for i in range(200)] * 2, ["b", "a", None, "c"])
    r = mixing.taken(d).collect()
    assert len(r) == len(TEXTS) + 400
    total = sum(x.size for x in r)
    assert abs(sum({x.source_size: x.target for x in r}.values()) - 1.5 * total) < 1e-6
    assert all(0 <= x.taken <= 2 * x.size and x.target <= 2 * x.source_size for x in r)
    for s in {x.source_size for x in r}:
        took, target = sum(x.taken for x in r if x.source_size == s), next(x.target for x in r if x.source_size == s)
        assert abs(took - target) < 0.05 * target + 300
    key = lambda x: (str(x.doc_id), x.size, x.taken)
    assert sorted(map(key, r)) == sorted(map(key, mixing.taken(d.repartition(7)).collect()))
    docs = mixing.mixed_documents(d)
    assert docs.columns == d.columns and sum(len(words(x.text)) for x in docs.collect()) == sum(x.taken for x in r)
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_sentencepiece(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    texts = TEXTS + ["▁mark  and   blanks ", "😀 日本語 \x00 end", "  lead"]
    r = sp.decode(sp.encode(table(spark, texts), path), path).collect()
    for x in r:
        assert x.ids == (None if x.text is None else library.encode(x.text))
        assert x.text is None or (x.parity and x.round_trip and x.decoded == x.text.replace("▁", " "))
    assert sp.encode(empty(spark), path).count() == 0


def composed_model(charsmap=b"", dummy=True, collapse=False):
    """A unigram model of a few pieces and all bytes."""
    import struct

    def varint(n):
        return bytes([n & 127 | (128 if n > 127 else 0)]) + (varint(n >> 7) if n > 127 else b"")

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (varint(len(body)) + body if kind == 2 else body)

    def piece(p, s, t):
        return field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t])))

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)] + [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁ab", -6.0), ("▁a", -5.5), ("bb", -7.0))]
    trainer = field(2, 2, field(3, 0, b"\x01") + b"\x98\x02\x01")
    normal = field(3, 2, (field(2, 2, charsmap) if charsmap else b"") + field(3, 0, bytes([dummy])) + field(4, 0, bytes([collapse])) + field(5, 0, b"\x01"))
    return b"".join(piece(*p) for p in pieces) + trainer + normal


def library_charsmap():
    """The NFKC table that the sentencepiece library brings along."""
    from sentencepiece import SentencePieceNormalizer

    return sp.parse(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())["charsmap"]


RAW = ["ab", "abb ab", "aabb", "b é a", "", " ", "  ab  b ", "ab\n", "\nab b\t", "a ▁b▁", "▁", "ＡＢ ａｂ ﬁ ½", "ab\u3000ab", "\x00a", "  \n ", "é" * 3000]


@pytest.mark.parametrize("collapse", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("mapped", [False, True])
def test_unigram_model_on_raw_texts(mapped, dummy, collapse):
    c = sp.Codec(composed_model(library_charsmap() if mapped else b"", dummy, collapse))
    for t in RAW:
        ((ids, back, same),) = c.encode([t])
        got = np.frombuffer(ids, "<i4").tolist()
        assert same and back and got == c.library.encode(t), t
        assert c.decode(got) == c.expected(t).replace("▁", " ")


def test_wrong_normaliser_is_found(spark, tmp_path):
    from tokenizers import normalizers

    path = f"{tmp_path}/composed.model"
    with open(path, "wb") as f:
        f.write(composed_model())
    c = sp.Codec(composed_model())
    c.normaliser = normalizers.Sequence([normalizers.Replace("b", "a")])
    ((ids, back, same),) = c.encode(["ab"])
    assert same and back and np.frombuffer(ids, "<i4").tolist() != c.library.encode("ab")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(RAW)], "doc_id long, text string")
    assert all(x.parity and x.round_trip for x in sp.encode(d, path, whole_share=1).collect())


def test_parity_is_of_every_row(spark, tmp_path):
    """The rebuilt normaliser loses the second mark of a letter, so that ids differ from the library's though every word agrees."""
    path = f"{tmp_path}/composed.model"
    with open(path, "wb") as f:
        f.write(composed_model(library_charsmap()))
    c = sp.Codec(composed_model(library_charsmap()))
    texts = [f"ab e\u0301\u0323 {'ab ' * i}b" for i in range(40)] + [f"ab {'a' * i}" for i in range(40)] + ["", None]
    ((_, back, same),) = c.encode(texts[:1])
    assert back and same
    r = sp.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert len(r) == len(texts)
    assert all(x.parity == (None if x.text is None else x.ids == c.library.encode(x.text)) for x in r)
    assert sum(x.parity is False for x in r) == 40
    with pytest.raises(ValueError):
        sp.encode(empty(spark), path, whole_share=64)


def test_word_table_is_bounded(monkeypatch):
    """With a table of a few words, turned over at each call, ids stay those of the library."""
    monkeypatch.setattr(sp, "KEPT_BYTES", 300)
    c = sp.Codec(composed_model())
    for i in range(12):
        texts = ["ab b", f"a{'b' * (i % 4)} x{i}", "ab  b"]
        for t, (ids, back, same) in zip(texts, c.encode(texts), strict=True):
            assert back and same and np.frombuffer(ids, "<i4").tolist() == c.library.encode(t)
    assert len(c.young) + len(c.old) < 12


def test_importance(spark):
    r = np.random.default_rng(1)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"], 80)) for _ in range(60)]
    bad = [" ".join(r.choice(["junk", "spam", "click", "here"], 80)) for _ in range(60)]
    d = table(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    x = importance.resample(d, labels).collect()
    held = [y for y in x if y.doc_id is not None and y.doc_id % 2 and y.doc_id < 120]
    assert np.mean([y.kept == (y.doc_id < 60) for y in held]) > 0.95
    assert sorted(y["rank"] for y in x) == list(range(122))
    keys = [y.key for y in sorted(x, key=lambda y: y["rank"])]
    assert keys == sorted(keys, reverse=True)
    assert importance.resample(empty(spark), labels).count() == 0


def test_dom_model(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>Bold<br><p>Some   text\nhere</p><form><input>Mail</form></article><aside class="sidebar"><p>Side</p></aside><div class="comments"><p>Nice page</p></div><footer>Foot</footer></body>'
    d = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (None, "v", "", 3), (4, "w", "<p", 3)], "page_id long, url string, html string, n_chars int")
    got = {x.page_id: x for x in dom_model.extracted(d).collect()}
    assert got[1].text == "Head & tail\nBold\nSome text here" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[None].n_chars == 0
    w, e = dom_model.trained()
    wrong = [np.mean((np.array(dom_model.marginals(t, w, e)) > 0.5) != dom_model.labels_of(t, c)) for p, c in dom_model.composed_pages(40, seed=77) for t in [dom_model.Tree(p)]]
    assert np.mean(wrong) < 0.08


def test_marginals_are_exact():
    tree = dom_model.Tree("<div class=ad><p>a</p><p>b<i>c</i></p></div><article><p>d</p></article>")
    w, e = dom_model.trained()
    logit, n = tree.features() @ w, len(tree.tag)
    total, on = 0.0, np.zeros(n)
    for bits in range(1 << n):
        s = [(bits >> i) & 1 for i in range(n)]
        v = np.exp(sum(-np.log1p(np.exp(-z if y else z)) for z, y in zip(logit, s)) + sum(e[s[tree.parent[i]], s[i]] for i in range(1, n)))
        total += v
        on += v * np.array(s)
    assert np.allclose(dom_model.marginals(tree, w, e), on / total)


def test_licenses(spark):
    s = licenses.Scanner()
    texts = ["Released under the MIT License.", f"{LONG[:500]}\nlicensed under the  APACHE license version 2.0\nx y", None, "", "licensed software notice", licenses.TEMPLATES[15][1].replace(", ", ",\n")]
    got = {(x.doc_id, x.license) for x in licenses.scan(table(spark, texts)).collect()}
    assert got == {(0, "MIT"), (1, "Apache-2.0"), (5, "MIT")}
    for t in texts:
        for _, unit in s.units(t or ""):
            a = licenses.bigrams(unit)
            brute = {}
            for name, b in s.sets:
                dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if dice >= s.limit:
                    brute[name] = max(dice, brute.get(name, 0))
            assert s.best(unit) == brute and (not brute or s.promising(unit))
    assert licenses.scan(empty(spark)).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    v = [list(map(float, x)) for x in r.normal(size=(120, 16))]
    for i in range(40):
        v.append([x + float(y) for x, y in zip(v[i % 8], r.normal(size=16) * 0.05)])
    v += [v[3], v[3], None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [3e38] * 16, [1e38] * 16]
    d = spark.createDataFrame([(i, x, 1, "k") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int, kept string")
    f = lambda x: np.array(x, np.float32).astype(float) if x and None not in x and np.isfinite(x).all() and any(x) else None
    u = [f(x) for x in v]
    u = [None if x is None else x / np.abs(x).max() for x in u]
    u = [None if x is None else x / np.linalg.norm(x) for x in u]
    link = lambda i, j: i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.9
    got = {x.vec_id: x for x in projection.near_vectors(d, block=16).collect()}
    assert len(got) == len(v)
    for i in range(len(v)):
        near = {i}
        while more := {j for j in range(len(v)) if j not in near and any(link(k, j) for k in near)}:
            near |= more
        assert (got[i].n_links, got[i].component_id) == (sum(link(i, j) for j in range(len(v))), min(near))


def test_embedding_plan_bounds_misses():
    """Bits and passes follow from the number of vectors, and no pair at the threshold is missed more often than stated."""
    assert projection.plan(1) == projection.plan(1024) == (1, 0)
    last = (1, 0)
    for n in (10**4, 10**5, 10**6, 10**9):
        passes, bits = projection.plan(n)
        assert n / 2**bits <= 1024 and passes > last[0] and bits > last[1]
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes <= 1e-6
        last = passes, bits


def test_embedding_recall_by_brute_force(spark):
    """A dense cone, where a short window holds no partner: every pair just above the threshold is found, through several passes and blocks."""
    r = np.random.default_rng(6)
    cone = r.normal(size=32) + r.normal(size=(3000, 32)) * 0.8
    pairs = cone[:300] + r.normal(size=(300, 32)) * 0.42
    v = np.concatenate([cone, pairs])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = np.arange(len(v))
    while True:
        low = np.array([min(c, comp[h].min()) if h.any() else c for c, h in zip(comp, hit, strict=True)])
        if (low == comp).all():
            break
        comp = low
    assert 50 < hit.any(axis=1).sum() < 3300
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in projection.near_vectors(d, stretch=64, block=64).collect()}
    assert got == {i: (int(h.sum()), int(c)) for i, (h, c) in enumerate(zip(hit, comp, strict=True))}


def test_licenses_beside_other_words():
    """Notices within lines, sentences and comment blocks, full texts, and the best window against all windows."""
    s = licenses.Scanner()
    by = {}
    for name, t in licenses.TEMPLATES:
        by.setdefault(name, []).append(t)
    assert {"AGPL-3.0", "BSD-3-Clause", "EPL-2.0", "LGPL-2.1", "LGPL-3.0", "Unlicense"} <= set(by)
    assert s("Copyright 2020 Jane Doe. Released under the MIT License.") == [("MIT", 1.0, 0)]
    assert s(f"One sentence stands here.\nAnother one has words of its own. Released under the MIT License. And a third one follows it, {LONG[:300]}") == [("MIT", 1.0, 1)]
    block = "# a tool\n" + "\n".join(f"# {x}" for x in by["MIT"][-1].split(". "))
    assert ("MIT", 1.0, 1) in s(block)
    for name, t in licenses.TEMPLATES:
        assert (name, 1.0) in [x[:2] for x in s(f"{LONG[:200]}\nour project: {t} {LONG[200:400]}")]
    assert s("licensed software notice under the license of this work") == []
    rng = np.random.default_rng(4)
    for name, t in licenses.TEMPLATES[:9]:
        ws = t.split()
        for p in rng.choice(len(ws), len(ws) // 8, replace=False):
            ws[p] = "other"
        doc = f"under the {LONG[:100]} this work {' '.join(ws)} of the license {LONG[100:200]} {t.split()[0]}"
        words_ = licenses.WORDS.findall(doc.lower())
        grams, best = list(zip(words_, words_[1:])), {}
        for other, b in s.sets:
            if len(b) < 300:
                for i in range(len(grams)):
                    for j in range(i + 1, min(len(grams), i + 2 * len(b)) + 1):
                        w = set(grams[i:j])
                        dice = 2 * len(w & b) / (len(w) + len(b))
                        if dice >= s.limit:
                            best[other] = max(dice, best.get(other, 0))
        assert {x[0]: x[1] for x in s(doc)} == best


def test_line_templates_of_several_families_in_a_leaf(spark):
    """Two families of one leaf whose votes tie, and a third beside a large one: each pair agrees in 13 of 14 places."""
    head = "And reornd atou"
    body = lambda f: [f"{f}{c}" for c in "abcdefghijk"]
    line = lambda f, k, w: f"{head} {' '.join(w if i == k else x for i, x in enumerate(body(f)))}"
    families = [[line("p", 2, "one"), line("p", 2, "two")], [line("q", 5, "three"), line("q", 5, "four")], [line("r", 9, x) for x in ("u", "v", "w", "x")]]
    for chosen in (families[:2], families):
        lines = [x for f in chosen for x in f]
        d = spark.createDataFrame([(i, x, "a") for i, x in enumerate(lines)], "doc_id long, text string, source string")
        got = {x.doc_id: x.n_dropped for x in line_templates.line_dedup(d).collect()}
        firsts = {lines.index(f[0]) for f in chosen}
        assert got == {i: int(i not in firsts) for i in range(len(lines))}
