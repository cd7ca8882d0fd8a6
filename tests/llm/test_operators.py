"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows, clashing columns; and on none."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import embeddings, gif, language_id, licenses, mixing, packing, pii, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, id string, taken long, v1 int, label string, cell string, component string"
WORDS = "the of and river stone light under seven maple copper window quiet thunder paper".split()


def rows():
    r = random.Random(3)
    out = []
    for i in range(60):
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(5, 60)))
        out.append((i, text, "en" if i % 2 else None, f"s{i % 4}" if i % 7 else None))
    out += [(60, None, None, None), (61, "", "en", "s1"), (62, " \n\t ", None, "s0"), (63, "word " * 30000, "en", "s2"), (None, "a null id here", None, "s3")]
    out += [(64, out[3][1], "en", "s1"), (65, out[3][1], "en", "s1"), (3, *out[3][1:]), (66, out[5][1] + " extra", "en", "s9")]
    return [(*x, len(x[1] or ""), 1, 2.0, "x", 5, 6, "l", "c", "k") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- mixing ------------------------------------------------------------------------------------------


def water(sizes):
    """Targets by the contract's own words: cap, share the excess again, until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_targets(docs):
    got = mixing.pareto_mix(docs).collect()
    assert len(got) == len(rows())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water(dict(sizes))
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    for s in want:
        assert abs(taken[s] - want[s]) <= 1.5
    again = mixing.pareto_mix(docs).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_text_and_empty(docs, none):
    out = mixing.mixed_documents(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = sum(len(r["text"].split()) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.pareto_mix(docs).collect())
    assert mixing.pareto_mix(none).count() == 0


# -- embeddings -----------------------------------------------------------------------------------------


def check_vectors(table, got):
    """Rows of (id, vector, label, n_links, component, kept) against all pairs of rows."""
    good = [k for k, (_, v, lab) in enumerate(table) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {k: np.array(table[k][1], float) / np.linalg.norm(table[k][1]) for k in good}
    parent = list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(table)
    for k, a in enumerate(good):
        for b in good[:k]:
            if table[a][2] == table[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    names = defaultdict(list)
    for k, t in enumerate(table):
        names[find(k)] += [] if t[0] is None else [t[0]]
    name = [min(names[find(k)], default=None) for k in range(len(table))]
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(got, key=key) == sorted(((t[0], links[k], name[k], t[0] is not None and t[0] == name[k]) for k, t in enumerate(table)), key=key)


@pytest.mark.parametrize(("cell", "homes", "fan"), [(2048, 4096, 256), (20, 15, 16), (4, 5, 4)])
def test_embeddings_against_brute_force(spark, cell, homes, fan):
    r = np.random.default_rng(1)
    centers = r.normal(size=(20, 8))
    table = []
    for i in range(300):
        v = centers[i % 20] + r.normal(scale=0.25, size=8)
        table.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    table += [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [float("nan")] * 8, 1), (304, table[0][1], None), (305, table[0][1], 0), (306, table[0][1], 0), (307, [1.0, 2.0], 0), (308, [], 0), (309, [float(np.float32(x * 7)) for x in table[0][1]], 0)]
    # repeated ids with other vectors, null ids beside others and among themselves
    table += [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.0625], 5), (None, [1.0, 0.125], 5), (None, [-1.0, 0.0], 5), (None, [-1.0, 0.0], 5), (None, None, 5), (7, [-1.0, 0.125], 6), (None, [-1.0, 0.0], 6), (None, table[3][1], 0)]
    df = spark.createDataFrame([(*t, "x", 1, 2, "k") for t in table], "vec_id long, embedding array<float>, label int, cell string, n long, rep long, key string").repartition(4)
    got = [tuple(x) for x in embeddings.embedding_components(df, cell=cell, cell_homes=homes, fan=fan).collect()]
    check_vectors(table, got)
    if cell > 20:
        check_vectors(table, by_sql(table))
        assert embeddings.embedding_components(df.limit(0)).count() == 0


def by_sql(table):
    """The rows that the query's SQL gives for a table of (id, vector, label)."""
    import duckdb
    import pyarrow as pa

    columns = zip(*table, strict=True)
    types = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()}
    with duckdb.connect() as db:
        db.register("embeddings", pa.table({name: pa.array(list(c), t) for c, (name, t) in zip(columns, types.items(), strict=True)}))
        return db.execute(embeddings.OP2_SQL).fetchall()


# -- packing ---------------------------------------------------------------------------------------------


def test_packing_is_exact(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    pieces = packing.pack(docs, tokenizer(), open_windows=8).collect()
    want = sorted(tuple(tok.encode(x[1] or "", add_special_tokens=False).ids + [0]) for x in rows())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    texts = defaultdict(list)
    for x in rows():
        texts[x[0]].append(x[1] or "")
    for doc, found in by_doc.items():
        ids = tok.encode(texts[doc][0], add_special_tokens=False).ids + [0]
        raw = np.asarray(ids, "<u4").tobytes()
        spans = sorted((p["start"], p["length"]) for p in found)
        copies = len(texts[doc])
        assert sum(n for _, n in spans) == copies * len(ids)
        for p in found:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(raw[4 * p["start"] : 4 * (p["start"] + p["length"])])
    assert sum(len(w) for w in want) == sum(p["length"] for p in pieces)
    assert packing.pack(none, tokenizer()).count() == 0


def test_fast_encoder_on_every_character():
    # the second encoder against the tokenizer on all characters that a text can hold, alone, doubled and beside letters
    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_file(tokenizer()), packing.WordCache(tokenizer())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or 0xA000 <= c < 0x20000 and c % 2 == 0)]
    for k in range(0, len(points), 4000):
        words = [w for c in points[k : k + 4000] for ch in [chr(c)] for w in (ch, f"a{ch}b{ch}{ch}") if w.strip(" ") == w and w]
        texts = [f"x {w} y" for w in words]
        assert cache.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in plain.encode_batch_fast(texts, add_special_tokens=False)]


def test_word_cache_equals_tokenizer():
    cache = packing.WordCache(tokenizer(), kept=50)
    r = random.Random(1)
    parts = [" ", "  ", "\n", "a", "'s", "12", ".", "\t", "é", "<|endoftext|>", "　", "\x1c", "word", " x", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, 3000, 500):
        assert cache.encode(texts[k : k + 500]) == want[k : k + 500]


# -- languages ---------------------------------------------------------------------------------------------


def test_language_models():
    text = "the quick brown fox jumps over the lazy dog again and again".split()
    from collections import Counter

    model = language_id.kneser_ney(language_id._grams(Counter(text * 3)))
    # probabilities after a context sum to one over all characters, unseen ones sharing the rest
    letters = sorted({c for w in text for c in w} | {language_id.END})
    one = language_id.Scorer([model])
    assert one.totals(["the the"])[0, 0] == pytest.approx(2 * one.totals(["the"])[0, 0])
    assert one.totals(["", "123 !!"])[:, 1].tolist() == [0, 0]
    assert one.totals(["the"])[0, 0] > one.totals(["xqz"])[0, 0] and len(letters) > 5


def plain_kneser_ney(words):
    """The probability of a character after a context, straight from the definition."""
    raw = defaultdict(int)
    for w in words:
        s = language_id.BEGIN + w + language_id.END
        for i in range(1, len(s)):
            raw[s[max(0, i - language_id.ORDER + 1) : i + 1]] += 1
    levels = {language_id.ORDER: {g: n for g, n in raw.items() if len(g) == language_id.ORDER}}
    for k in range(language_id.ORDER - 1, 0, -1):
        now = defaultdict(int, {g: n for g, n in raw.items() if len(g) == k})
        for g in levels[k + 1]:
            now[g[1:]] += 1
        levels[k] = dict(now)
    size = len(levels[1]) + 1

    def discount(k):
        ones, twos = (sum(n == m for n in levels[k].values()) for m in (1, 2))
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(c, h):
        k = len(h) + 1
        lower = p(c, h[1:]) if h else 1 / size
        after = {g: n for g, n in levels[k].items() if g[:-1] == h}
        if not after:
            return lower
        total, d = sum(after.values()), discount(k)
        return max(after.get(h + c, 0) - d, 0) / total + d * len(after) / total * lower

    return p, sorted(levels[1])


def test_kneser_ney_against_its_definition():
    from collections import Counter

    r = random.Random(11)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 7))) for _ in range(120)] + ["abba"] * 5
    scorer = language_id.Scorer([language_id.kneser_ney(language_id._grams(Counter(words)))])
    p, letters = plain_kneser_ney(words)
    for h in ("", "^", "^a", "ab", "abba", "^abb", "zz"):
        assert sum(p(c, h) for c in [*letters, "?"]) == pytest.approx(1.0)
    for w in [*words[:30], "abcabc", "zebra", "q", "eeeeeeee"]:
        s = "^" + w + "$"
        want = sum(np.log(p(s[i], s[max(0, i - language_id.ORDER + 1) : i])) for i in range(1, len(s)))
        total, n = scorer.totals([w])[0]
        assert total == pytest.approx(want, rel=1e-5) and n == len(s) - 1


def test_many_languages_and_calibrated_rejection(spark):
    r = random.Random(6)
    # 150 languages, each with an alphabet and words of its own
    vocabulary = {f"l{k:03d}": ["".join(chr(0x4E00 + 40 * k + r.randrange(30)) for _ in range(r.randint(2, 6))) for _ in range(25)] for k in range(150)}
    table = [(i, " ".join(r.choice(vocabulary[f"l{i % 150:03d}"]) for _ in range(r.randint(3, 30))), f"l{i % 150:03d}") for i in range(6000)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    known = language_id.train(df)
    assert len(known.languages) == 150
    got = {x["id"]: x for x in language_id.identify(df, known).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in table) >= 0.99 * len(table)
    # the rate of false rejections on rows that were never learned from, and of true ones on other scripts
    pool = ["the and of with river stone light under house water".split(), "le la les des rivière pierre lumière sous maison été".split()]
    table = [(i, " ".join(r.choice(pool[i % 2]) + r.choice(["", "s", "e", "ing"]) for _ in range(r.choice([1, 2, 5, 20, 80]))), "ef"[i % 2]) for i in range(6000)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    known = language_id.train(df, sample_rows=1500)
    held = {i for i, _, _ in table if zlib.crc32(str(i).encode()) % 3 == 1}
    got = {x["id"]: x for x in language_id.identify(df, known).collect()}
    assert sum(got[i]["rejected"] for i in held) <= 2
    strange = [(i, t) for i, t in enumerate(["qzxj wvkq jjxq zzkw qxqx kvzj " * 5, "река камень свет под домом вода течёт тихо", "0101 abcdefghijklmnopqrstuvwxyz zyxwvutsrqponmlkjihgfedcba"])]
    far = language_id.identify(spark.createDataFrame(strange, "doc_id long, text string"), known).collect()
    assert all(x["rejected"] and x["score"] < 0.5 for x in far)


def test_tail_limit():
    r = np.random.default_rng(0)
    values = r.exponential(0.2, 20_000) + 3
    limit = language_id.tail_limit(values, rejected=1e-4)
    assert 0.3e-4 < (r.exponential(0.2, 2_000_000) + 3 > limit).mean() < 3e-4
    assert language_id.tail_limit(np.ones(50)) == 1.0


def test_language_id(spark, none):
    r = random.Random(2)
    en, fr = "the and of with river stone light under house water".split(), "le la les des rivière pierre lumière sous maison été".split()
    table = [(i, " ".join(r.choice(en if i % 2 else fr) for _ in range(12)), ("en" if i % 2 else "fr") if i % 5 else None) for i in range(300)]
    table += [(300, None, "en"), (301, "123 !?", "fr"), (302, "", None), (None, "the river", None)]
    df = spark.createDataFrame([(*t, "x", 1.0) for t in table], "doc_id long, text string, lang string, lang_pred string, score double")
    known = language_id.train(df)
    got = {x["id"]: x for x in language_id.identify(df, known).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(300))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (300, 301, 302))
    assert not any(got[i]["rejected"] for i in range(300)) and 0 <= got[None]["score"] <= 1
    assert language_id.accepted(df).count() == 301
    empty = language_id.train(none)
    assert language_id.identify(none, empty).count() == 0
    assert language_id.identify(df, empty).filter("lang_pred != 'und'").count() == 0


# -- toxicity ----------------------------------------------------------------------------------------------


def test_automaton_is_exactly_one_edit():
    terms = {"idiot": 3.0, "scum": 2.0, "trash": 2.5, "worthless": 3.0, "vequ*": 1.0}
    m = toxicity.Matcher(toxicity.Lexicon(terms))

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                e, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, e + (x != y))
        return d[-1]

    r = random.Random(4)
    words = [t.rstrip("*") for t in terms]
    tried = list(words)
    for _ in range(4000):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "x", "t", "i"])
        tried.append("".join(w))
    for w in tried:
        whole = [t for t in terms if not t.endswith("*") and distance(w, t) <= (1 if len(t) >= toxicity.FUZZY_FROM else 0)]
        stem = w.startswith("vequ")
        assert (m.match(w) is not None) == bool(whole or stem), w


def test_word_beside_its_stem():
    m = toxicity.Matcher(toxicity.Lexicon({"idiot": 3.0, "idiot*": 2.0, "idio*": 1.0, "loser": 2.0, "loser*": 2.0, "scum": 1.0, "scum*": 1.0}))
    assert m.match("idiot") == ("idiot", 0) and m.match("loser") == ("loser", 0)
    for w in ("idiiot", "idoot", "xidiot", "idot"):
        assert m.match(w) == ("idiot", 1), w
    assert m.match("lozer") == ("loser", 1) and m.match("loer") == ("loser", 1)
    # longer words are their longest stem's, to the letter
    assert m.match("idiots") == m.match("idiotic") == ("idiot*", 0) and m.match("idiom") == ("idio*", 0)
    assert m.match("losers") == ("loser*", 0) and m.match("scums") == ("scum*", 0)
    assert m.match("lozers") is None and m.match("scm") is None and m.match("xidiots") is None


def test_toxicity(spark, none):
    r = random.Random(5)
    table, labels = [], []
    for i in range(400):
        words = [r.choice(WORDS) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[7] = "idiot"
            words[20] = "worthless"
        table.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    table += [(1000, "you are an idiott and worthles"), (1001, None), (1002, ""), (None, "the river")]
    df = spark.createDataFrame([(*t, 0.5, "x") for t in table], "doc_id long, text string, score double, toxic string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    known = toxicity.train(df, lab)
    got = {x["doc_id"]: x["score"] for x in toxicity.score_documents(df, known).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(400))
    assert got[1001] == got[1002] < 0.7 and "idiot" in known.lexicon.weights
    assert toxicity.score_documents(none, toxicity.train(none, lab.limit(0))).count() == 0


def test_quotation_is_told_apart():
    tokens = 'he said "you idiot" to them all and that was the end of it then idiot'.split()
    assert toxicity._quoted(tokens, tokens.index('idiot"'))
    assert not toxicity._quoted(tokens, len(tokens) - 1)


# -- personal data ------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]

    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text or "") if ok(k, m.group())]


def test_personal_data(spark, none):
    texts = ["a@b.c_x@d.e mail x@y@c.d.e +1 (234) 555-1234 and 001.002.3.4.5 1.2.3.256", None, "", "4" * 20000, "a." * 9000 + "@b" + ".c" * 9000, "1." * 9000, "+1 +12345678- +1((((((((((", "é😀 4111 1111 1111 1111 or 4111-1111-1111-1112", "call me at 555-123-4567 or mail bob (at) site (dot) com", "version 1.2.3.4 and 10.0.0.1"]
    r = random.Random(8)
    texts += ["".join(r.choice(["1", "4", ".", "@", "a", "+", " ", "-", "(", ")", "b.c", "255", "é"]) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, t int, base int")
    for x in pii.find_spans(df).collect():
        got = [f"{pii.KINDS[s['k']]}:{s['s']}:{s['e']}" for s in x["base"]]
        assert got == base_spans(texts[x["id"]]), texts[x["id"]]
        for a in x["added"]:
            assert all(a["e"] <= s["s"] or a["s"] >= s["e"] for s in x["base"])
    full = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    clean = {x["doc_id"]: x["text"] for x in pii.redacted(full).collect()}
    assert clean[7] == "é😀 [CARD] or 4111-1111-1111-1112" and clean[1] is None and clean[2] == ""
    assert pii.find_spans(none).count() == 0


def test_redaction_and_many_spans(spark):
    import time

    text = "ünder the stone a{0}@b.example 10.0.{1}.7 call 555-123-{2:04d} or bob (at) site{0} (dot) com, 4111 1111 1111 1111;"
    many = "".join(text.format(i, i % 256, i % 10000) for i in range(25_000))  # 125,000 spans in three million characters
    df = spark.createDataFrame([(1, many, "en", "s"), (2, text.format(1, 2, 3), "en", "s"), (3, "plain é", "en", "s")], "doc_id long, text string, lang string, source string").repartition(1)
    begun = time.time()
    got = {x["id"]: x for x in pii.find_spans(df).collect()}
    assert [f"{pii.KINDS[s['k']]}:{s['s']}:{s['e']}" for s in got[1]["base"]] == base_spans(many)
    clean = {x["doc_id"]: x["text"] for x in pii.redacted(df).collect()}
    assert time.time() - begun < 150
    for i, whole in ((1, many), (2, text.format(1, 2, 3)), (3, "plain é")):
        out, at = [], 0
        for s in sorted([*got[i]["base"], *got[i]["added"]], key=lambda s: (s["s"], s["e"], s["k"])):
            if s["s"] >= at:
                out += [whole[at : s["s"]], f"[{pii.KINDS[s['k']].upper()}]"]
            at = max(at, s["e"])
        assert clean[i] == "".join([*out, whole[at:]])


def test_spans_clear_of_others(spark):
    r = random.Random(2)
    table = []
    for i in range(200):
        spans = [sorted(r.sample(range(60), 2)) for _ in range(r.randint(0, 12))]
        table.append((i, [(*x, "m", "b", "a") for x in spans[::2]], [(*x, "m", "b", "a") for x in spans[1::2]]))
    df = spark.createDataFrame(table, f"i int, loose array<{pii.SPAN}>, taken array<{pii.SPAN}>")
    for x in df.select("i", pii._clear(F.col("loose"), [F.col("taken")]).alias("free")).collect():
        _, loose, taken = table[x["i"]]
        assert sorted((y["s"], y["e"]) for y in x["free"]) == sorted(y[:2] for y in loose if all(y[1] <= z[0] or z[1] <= y[0] for z in taken))


def test_labelers_reliability():
    # a labeler that agrees with the others is trusted more than one that says the same of everything
    table = [((0, 0, 1, 1, 1, 1), 80), ((0, 0, -1, -1, -1, 1), 80), ((0, 0, 1, 1, -1, 1), 5)]
    belief, says = pii.reliabilities(table)
    assert belief[table[0][0]] > 0.9 > 0.1 > belief[table[1][0]]
    assert says[0, 0, True][1] / says[0, 0, False][1] > says[0, 3, True][1] / says[0, 3, False][1]
    assert pii.train([]) == {}


# -- licenses ---------------------------------------------------------------------------------------------------


def test_licenses(spark, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = ["MIT License cc by cc-by CC BY-NC 4.0; GNU General Public License, version 3", None, "", "MİT license apache  LICENSE\nmit\tlicense", "cc " * 300 + "by", "x " * 50000 + "apache license", "cc-------by", "SPDX-License-Identifier: Apache-2.0", "plain text"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score int")
    for x in licenses.scan_licenses(df).collect():
        w = word.findall((texts[x["doc_id"]] or "").translate(lower))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= x["score"] <= 1 and set(x["base_labels"].split(",")) <= set(x["labels"].split(",")) | {""}
        for a in x["detections"]:
            assert not any(b["s"] <= a["s"] and a["e"] <= b["e"] and b["p"] < a["p"] for b in x["detections"])
    got = {x["doc_id"]: x["labels"] for x in licenses.scan_licenses(df).collect()}
    assert "cc-by-nc-4.0" in got[0] and "gpl-3.0" in got[0] and got[7] == "apache-2.0" and got[8] == ""
    assert licenses.scan_licenses(none).count() == 0
    patterns = [re.compile(r.pattern) for r in licenses.rules()]
    assert len(patterns) > 150


def example(pattern):
    """The shortest text of a signature: first alternatives, least repeats."""
    from re import _parser

    def of(parts):
        out = ""
        for op, arg in parts:
            if op is _parser.LITERAL:
                out += chr(arg)
            elif op is _parser.IN:
                out += chr(arg[0][1] if arg[0][0] is _parser.LITERAL else arg[0][1][0])
            elif op is _parser.MAX_REPEAT:
                out += of(arg[2]) * arg[0]
            elif op is _parser.SUBPATTERN:
                out += of(arg[3])
            else:
                assert op is _parser.BRANCH
                out += of(arg[1][0])
        return out

    return of(_parser.parse(pattern))


def test_each_signature_alone(spark):
    every = licenses.rules()
    spelt = {"Released under the MIT": "mit", "BSD 3-Clause": "bsd-3-clause", "BSD-2-Clause": "bsd-2-clause", "Apache 2.0": "apache-2.0", "WTFPL": "wtfpl", "CDDL-1.0": "cddl-1.0", "0BSD": "0bsd", "MIT No Attribution": "mit-0", "CeCILL 2.1": "cecill-2.1", "Unauthorized copying of this file, via any medium, is strictly prohibited": "proprietary"}
    alone = [(example(r.pattern), r.label) for r in every] + list(spelt.items())
    df = spark.createDataFrame([(i, f"Notes. {text.upper()}\n(end)") for i, (text, _) in enumerate(alone)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in licenses.scan_licenses(df).collect()}
    for i, (text, label) in enumerate(alone):
        # a stronger signature may hold the same words
        padded = f" notes {re.sub('[^a-z0-9]+', ' ', text.lower())} end "
        place = [(d["s"], d["e"]) for d in got[i]["detections"]]
        names = got[i]["labels"].split(",")
        held = {r.label for r in every if (m := re.search(f"(?<= )(?:{r.pattern})(?= )", padded)) and m.span() in place}
        assert place and (label in names or held & set(names)), text
        assert got[i]["score"] > 0, text
    exact = {text: got[len(every) + i]["labels"].split(",") for i, text in enumerate(spelt)}
    assert all(label in exact[text] for text, label in spelt.items()), exact
    assert len(licenses.WRITTEN) > 200


def test_keywords_lose_no_spelling(spark):
    assert licenses.spellings("a(?: b|c)?[xy]") == ["ax", "ay", "a bx", "a by", "acx", "acy"]
    every = licenses.rules()
    for r in every:
        for text in licenses.spellings(r.pattern):
            spelt = text.replace(licenses.OPEN, "7")
            if re.fullmatch(r.pattern, spelt) is None:
                spelt = text.replace(licenses.OPEN, "a")
            assert re.fullmatch(r.pattern, spelt), (r.pattern, text)
            assert all(any(w in spelt.split() for w in any_of) for any_of in licenses.keywords(r.pattern)), (r.pattern, text)


def test_many_detections(spark):
    # containment against all pairs, on a text of thousands of detections
    text = "cc by nc 4 0 international apache license version 2 0 gnu lesser general public license v 3 cc by " * 1500
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_base"] == 1500 * 3
    one = licenses.scan_licenses(spark.createDataFrame([(1, text[: len(text) // 1500])], "doc_id long, text string")).first()
    assert len(got["detections"]) == 1500 * len(one["detections"]) and got["labels"] == one["labels"] and got["score"] == one["score"]
    every = [(m.start(), m.end(), r.priority, r.label) for r in licenses.rules() for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", f" {text[: len(text) // 1500]} ")]

    def holds(a, b):
        return a[0] <= b[0] and a[1] >= b[1] and (a[2] <= b[2] if a[1] - a[0] > b[1] - b[0] else a[2:] < b[2:])

    kept = {x for x in every if not any(holds(y, x) for y in every)}
    assert {(d["s"], d["e"], d["p"], d["label"]) for d in one["detections"]} == kept


# -- token counts -------------------------------------------------------------------------------------------------


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    lengths = [len(tok.encode(x[1], add_special_tokens=False).ids) for x in rows() if x[1] is not None]
    h = token_counts.length_histogram(docs, tokenizer()).cache()
    for x in h.collect():
        n = x["n_tokens"]
        assert x["n_docs"] == lengths.count(n) and x["docs_over"] == sum(y > n for y in lengths)
        assert x["tokens_cut_to"] == sum(min(y, n) for y in lengths) and x["all_tokens"] == sum(lengths)
    for x in token_counts.at_limits(h, [0, 1, 17, 100, 10**6]).collect():
        limit = x["context"]
        assert x["tokens_kept"] == sum(min(y, limit) for y in lengths) and x["docs_whole"] == sum(y <= limit for y in lengths)
    assert token_counts.length_histogram(none, tokenizer()).count() == 0


def test_null_texts_complete_the_count(spark, docs):
    for x in token_counts.length_histogram(docs, tokenizer()).collect():
        assert x["null_texts"] == 1 and x["docs_at_most"] + x["docs_over"] + x["null_texts"] == len(rows())
    nulls = spark.createDataFrame([(None,), (None,)], "text string")
    x = token_counts.length_histogram(nulls, tokenizer()).first()
    assert (x["n_tokens"], x["n_docs"], x["null_texts"], x["share_at_most"]) == (0, 0, 2, None)


# -- GIF ------------------------------------------------------------------------------------------------------------


def test_gif_round_trip(docs, none):
    got = gif.read_back(gif.stored(docs)).collect()
    want = sorted(hashlib.sha256(gif.payload_of(x[1])[1]).hexdigest() for x in rows())
    assert sorted(x["payload_sha256"] for x in got) == want
    assert all(x["payload_bytes"] % 64 == 0 and x["payload_bytes"] >= max(64, x["n_bytes"]) for x in got)
    assert gif.read_back(gif.stored(none)).count() == 0
    frames = gif.frames_of(gif.stored(docs)).collect()
    assert all(sum(f["histogram"]) == 3 * f["width"] * f["height"] for x in frames for f in x["frames"])


def test_gif_feature_is_of_composed_frames(spark, docs):
    media = gif.stored(docs).cache()
    frames = {}
    for x in gif.frames_of(media).collect():
        frames.setdefault(x["doc_id"], []).append("frames=" + str(len(x["frames"])) + ";" + ";".join(f"{f['delay']}:" + "|".join(",".join(map(str, f["histogram"][k : k + 8])) for k in (0, 8, 16)) for f in x["frames"]))
    got = gif.read_back(media).collect()
    assert all(x["feature"] in frames[x["doc_id"]] for x in got)
    long = next(x["feature"] for x in got if x["doc_id"] == 63)
    assert long.startswith("frames=5;") and long.count(":") == 5 and long.count("|") == 10
    # other colours than grey: palette, transparency and the frame before it count
    data = bytearray(gif.write_gif(bytes(64 * 512) + b"\1" * 64))
    data[13:19] = bytes([255, 0, 0, 0, 0, 255])
    at = data.rindex(b"\x21\xf9\x04")
    data[at + 3], data[at + 4], data[at + 6] = 1 << 2 | 1, 25, 1
    df = spark.createDataFrame([(1, 0, bytes(data))], "doc_id long, n_bytes long, media binary")
    red = "0,0,0,0,0,0,0,32768|32768,0,0,0,0,0,0,0|32768,0,0,0,0,0,0,0"
    assert gif.read_back(df).first()["feature"] == f"frames=2;10:{red};25:{red}"


@pytest.mark.parametrize("data", [b"", b"\0", b"ab" * 5000, bytes(range(256)) * 80, random.Random(1).randbytes(40000)])
def test_lzw(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_disposal_transparency_and_interlace():
    import struct

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(pixels, w, h, left=0, top=0, disposal=1, clear=None, flags=0):
        # 2-bit codes: a clear before each pixel keeps widths at 3
        bits = []
        for p in pixels:
            bits += [4, p]
        bits.append(5)
        n = sum(c << 3 * i for i, c in enumerate(bits))
        coded = n.to_bytes((3 * len(bits) + 7) // 8, "little")
        return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0) + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + b"\x02" + bytes([len(coded)]) + coded + b"\0"

    data = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    data += frame([1, 1, 1, 1], 2, 2) + frame([2, 3], 2, 1, disposal=3, clear=3) + frame([3], 1, 1, 1, 1, disposal=2) + frame([2], 1, 1) + b";"
    f = list(gif.read_gif(data))
    red, green, blue, black = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert [x.rgb.tolist() for x in f] == [[[red, red], [red, red]], [[green, red], [red, red]], [[red, red], [red, blue]], [[green, red], [red, black]]]
    assert [x.delay for x in f] == [7] * 4
    tall = b"GIF89a" + struct.pack("<HHBBB", 1, 5, 0x81, 0, 0) + palette + frame([0, 3, 1, 2, 1], 1, 5, flags=0x40) + b";"
    assert next(gif.read_gif(tall)).indices[:, 0].tolist() == [0, 2, 1, 1, 3]
    with pytest.raises(ValueError):
        list(gif.read_gif(b"GIF89a\1\0"))


# -- SimHash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 3])
def test_simhash(spark, docs, none, cell_rows, monkeypatch):
    got = simhash.simhash_components(docs, cell_rows=cell_rows).collect()
    assert len(got) == len(rows())
    check_components(got, {x[0]: plain_fingerprint(x[1]) for x in rows()})
    if cell_rows > 3:
        assert simhash.simhash_components(none).count() == 0
        left = simhash.one_per_group(docs.select("doc_id", "text")).collect()
        assert sorted(str(x["doc_id"]) for x in left) == sorted({str(x["component_id"]) for x in got})
        monkeypatch.setattr(simhash, "TWO_BLOCKS_FROM", 1)
        check_components(simhash.simhash_components(docs).collect(), {x[0]: plain_fingerprint(x[1]) for x in rows()})


def test_simhash_repeated_and_null_ids(spark):
    r = random.Random(5)
    a, b = (" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(400)) for _ in range(2))
    near = a + " tail"
    assert 0 < (plain_fingerprint(a) ^ plain_fingerprint(near)).bit_count() <= 4 < (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count()
    table = [(7, a), (7, b), (2, near), (8, b), (None, a), (None, "lonely words of a null id"), (None, "lonely words of a null id"), (7, a)]
    df = spark.createDataFrame([(*t, "mark", 1) for t in table], "doc_id long, text string, mark string, fp int")
    got = sorted((str(x["doc_id"]), x["fingerprint"], x["component_id"]) for x in simhash.simhash_components(df).collect())
    group = {a: 2, near: 2, b: 7, table[5][1]: None}
    assert got == sorted((str(i), f"{plain_fingerprint(t):016x}", group[t]) for i, t in table)
    kept = sorted((str(x["doc_id"]), x["text"]) for x in simhash.one_per_group(df).collect())
    assert kept == sorted([("2", near), ("7", b), ("None", table[5][1])])  # the text b of an id that also has a is not lost


def test_crowded_anchor_streams():
    # a cell of many rows in many batches: only homes are held, and links are those of all pairs
    import pandas as pd

    r = np.random.default_rng(4)
    fps = np.unique(r.integers(0, 2**14, 3000).astype(np.uint64))
    home = r.random(len(fps)) < 0.3
    order = np.argsort(~home, kind="stable")
    cell = np.full(len(fps), 9)
    whole = pd.DataFrame({"cell": cell, "home": home[order], "fp": fps[order].view(np.int64)})
    whole = pd.concat([pd.DataFrame({"cell": [3, 3, 5], "home": [True, False, True], "fp": [1 << 40, 3 << 40, 5]}), whole, pd.DataFrame({"cell": [11, 11], "home": [True, False], "fp": [1 << 50, 3 << 50]})])
    for size in (7, 100, 10**6):
        found = list(simhash._compare(whole.iloc[k : k + size] for k in range(0, len(whole), size)))
        links = {(int(u), int(v)) for f in found for u, v in zip(f["u"], f["v"], strict=True)}
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for u, v in links:
            parent[find(u)] = find(v)
        assert find(1 << 40) == find(3 << 40) and find(1 << 50) == find(3 << 50)
        got = {}
        for x in whole["fp"][whole["cell"] == 9]:
            got.setdefault(find(int(x)), set()).add(int(x))
        parent = {}
        homes = [int(x) for x in fps[home]]
        for x in homes:
            for y in fps[np.bitwise_count(fps ^ np.uint64(x)) <= 4]:
                parent[find(int(y))] = find(x)
        want = {}
        for x in fps:
            want.setdefault(find(int(x)), set()).add(int(x))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def check_components(got, prints):
    ids = [i for i in prints if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                s, t = find(a), find(b)
                parent[max(s, t)] = min(s, t)
    for x in got:
        assert x["fingerprint"] == f"{prints[x['doc_id']]:016x}"
        assert x["component_id"] == (find(x["doc_id"]) if x["doc_id"] is not None else None)


@pytest.mark.parametrize("layout", [simhash.THREE_BLOCKS, simhash.TWO_BLOCKS])
def test_anchors_lose_no_pair(layout):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 200, dtype=np.uint64)
    fps = []
    for x in base:
        fps.append(int(x))
        for flips in range(1, 7):
            y = int(x)
            for b in r.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps = np.array(sorted(set(fps)), np.uint64)
    row, cell, home = simhash.anchor_rows(fps, layout)
    assert sum(home) == len(layout) * len(fps)
    place = {int(x): i for i, x in enumerate(fps)}
    u, v = ([place[int(x)] for x in side] for side in simhash.cell_links(cell, home, fps[row]))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u, v, strict=True):
        parent[find(a)] = find(b)
    for a in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 4)
        assert len({find(b) for b in near}) == 1
