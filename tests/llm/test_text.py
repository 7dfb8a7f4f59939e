import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundlake.llm import encode, mix, spam

ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "1", "23", "é", "日本", "!", "...", "'s", "'", "-", "http://x", " ", "😀", "²"]


@pytest.fixture(scope="module")
def tok():
    return encode.tokenizer(encode.vocabulary())


def pieces(tok, text, size):
    parts = encode.halves(text, size)
    assert "".join(parts) == text and all(0 < len(p) <= size for p in parts)
    return tok.tree([tok.encode(p) for p in parts])


def test_halving_and_joining_is_exact(tok):
    g = random.Random(1)
    for _ in range(4000):
        text = "".join(g.choice(ALPHABET[: g.choice([2, 4, 9, 21])]) for _ in range(g.randint(1, 100)))
        assert pieces(tok, text, g.randint(1, 20)) == tok.encode(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=200), st.integers(1, 40))
def test_any_text_is_exact(text, size):
    tok = encode.tokenizer(encode.vocabulary())
    text = text.encode(errors="ignore").decode()
    if text:
        assert pieces(tok, text, size) == tok.encode(text)


def test_long_unsplit_text(tok, monkeypatch):
    g = random.Random(2)
    runs = ["".join(g.choice("abcdefghij") for _ in range(20_000)), "日本語" * 3000, "=-" * 4000, " " * 5000 + "x", "\n" * 3000 + " y", "7" * 4000, "é" * 4000, "a" * 9000]
    widest = []
    original = encode.Tokenizer.piece
    monkeypatch.setattr(encode.Tokenizer, "piece", lambda self, data: widest.append(len(data)) or original(self, data))
    for text in runs:
        assert pieces(tok, text, 700) == tok.encode(text)
    assert widest and max(widest) < 3000  # the windows stay small in a long run
    assert tok.merged("unsplit text".encode()) == tok.piece(b"unsplit text")


def test_same_ids_as_the_other_library(tok):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(encode.vocabulary().replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("Hello <|endoftext|> you're 12 x²\n\n  y", "日本語 Ω 😀", "   "):
        assert tok.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_encode_rows(spark, tok):
    long = "word " * 500 + "x" * 5000 + " end" * 300
    rows = [(1, "a b"), (2, ""), (3, None), (4, long), (4, long), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS k", "3 AS piece")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in encode.encode(df, piece_chars=200, fan=3).collect())
    assert got == sorted((k or 0, tok.encode(t) if t else []) for k, t in rows)
    assert encode.encode(df.limit(0)).count() == 0


def test_documents_reach_the_tree(spark, tok, monkeypatch):
    """The supplied documents are joined out of leaves wherever they are longer than one, and all ids are those of both libraries."""
    from tokenizers import Tokenizer

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = []
    original = encode.laid_out
    monkeypatch.setattr(encode, "laid_out", lambda df, *a: original(seen.append(df) or df, *a))
    got = {r.doc_id: list(r.ids) for r in encode.encode(documents).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    other = Tokenizer.from_file(encode.vocabulary().replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    assert got == {k: tok.encode(t) for k, t in texts.items()}
    assert got == dict(zip(texts, (e.ids for e in other.encode_batch(list(texts.values()), add_special_tokens=False))))
    through = {r.k for r in seen[0].collect()}
    assert through == {k for k, t in texts.items() if len(t) > 2048} and len(through) > 20


def brute_mix(rows, goals, key):
    out = {}
    for s, (epochs, rest) in goals.items():
        run = 0
        for i, n in sorted(((i, n) for i, src, n in rows if src == s), key=lambda x: (key[x[0]], x[0])):
            run += n
            uses = epochs + (run <= rest)
            if uses:
                out[i] = uses
    return out


def test_mix_fills_budgets(spark):
    g = random.Random(3)
    rows = [(k, g.choice("aaab"), 0.25 + 0.75 * g.random(), g.randint(1, 50)) for k in range(800)] + [(900, "none", 1.0, 5), (901, None, 1.0, 5)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, weight double, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("missing", 0.1, 2), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    for bin_rows in (1000, 10):
        m = mix.select_documents(sizes.filter("source IN ('a', 'b')"), targets, bin_rows=bin_rows)
        goals = {r.source: (r.epochs, r.rest) for r in mix.plan(sizes, targets).collect()}
        key = {r.doc_id: r.key for r in mix.keyed(sizes, 7, 1).collect()}
        assert {r.doc_id: r.uses for r in m.documents.collect()} == brute_mix([(i, s, n) for i, s, _, n in rows if s in ("a", "b")], goals, key)
        shares = {r.source: r for r in m.shares.collect()}
        assert abs(shares["a"].actual_share - 1 / 3) < 0.01 and abs(shares["b"].actual_share - 2 / 3) < 0.01
        assert shares["missing"].tokens == 0 and shares["b"].most_uses <= 3 and len(shares) == 4
    small = mix.select_documents(sizes, targets, total_tokens=300)
    assert 200 < sum(r.n_tokens * r.uses for r in small.documents.collect()) <= 300


def test_a_given_total_is_kept_and_capped_sources_reported(spark):
    sizes = spark.createDataFrame([(k, "ab"[k % 10 == 0], 1.0, 10) for k in range(1000)], "doc_id bigint, source string, weight double, n_tokens bigint")  # a: 9000 tokens, b: 1000
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    got = lambda total: {r.source: (r.budget, r.tokens, r.capped) for r in mix.select_documents(sizes, targets, total_tokens=total).shares.collect()}
    assert got(None) == {"a": (3000, 3000, False), "b": (3000, 3000, False)}
    assert got(2000) == {"a": (1000, 1000, False), "b": (1000, 1000, False)}
    assert got(12_000) == {"a": (9000, 9000, False), "b": (3000, 3000, True)}
    assert got(10**9) == {"a": (18_000, 18_000, True), "b": (3000, 3000, True)}


def test_quality_prefers_what_is_typical_of_its_source(spark):
    log, prose = "10:%02d:47 INFO: log sink rotated %d", "The rotator behaved as planned in heavy rain and the crew waited %d minutes until %d."
    docs = [(k, " ".join([(log, prose)[k % 2] % (k % 60, k)] * 3), ("log", "mail")[k % 2]) for k in range(400)]
    docs += [(1000, prose % (7, 8), "log"), (1001, log % (5, 6), "mail")]  # mislabelled
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("log", 0.5, 2), ("mail", 0.5, 2)], "source string, target_share double, max_repeats int")
    weight = {r.doc_id: r.weight for r in mix.sized(df, targets).collect()}
    assert len(weight) == 402 and all(mix.LEAST < w < mix.MOST for w in weight.values())
    assert min(w for k, w in weight.items() if k < 1000) > max(weight[1000], weight[1001]) + 0.1


def test_quality_is_fitted_on_all_documents(spark, tok):
    import numpy as np

    g = random.Random(5)
    words = [[f"{a}{b}" for a in x for b in ("rotor", "panel", "cable", "x")] for x in (("sun", "dark", "cold"), ("10:", "11:", "12:"), ("ÿ", "日", "=="))]
    docs = [(k, " ".join(g.choice(words[k % 2] + words[2]) for _ in range(g.randint(1, 12))), ("log", "mail")[k % 2]) for k in range(6000)]
    docs += [(k, " ".join(words[2]), "rare") for k in (6001, 6002, 6002)]  # repeated rows count each
    docs += [(6003, "solar " * 900, "mail"), (6004, "", "mail"), (6005, "not wanted " * 50, "other"), (6006, "no source " * 50, None)]
    tokens = [(k, s, np.array(tok.encode(t), np.int64) * 2_654_435_761 % (1 << 32) >> 20) for k, t, s in docs if t and s in ("log", "mail", "rare")]
    tables = {s: sum(np.bincount(b, minlength=mix.BUCKETS) for _, x, b in tokens if x == s) for s in ("log", "mail", "rare")}
    whole = sum(tables.values()) + 1
    whole = whole / whole.sum()
    model = {s: np.log((t + mix.BUCKETS * whole) / (t.sum() + mix.BUCKETS) / whole) for s, t in tables.items()}
    want = {k: mix.LEAST + (mix.MOST - mix.LEAST) / (1 + np.exp(-model[s][b].mean())) for k, s, b in tokens}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("log", 0.5, 2), ("mail", 0.3, 2), ("rare", 0.2, 2), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    weights = lambda d: sorted((r.doc_id, r.weight, r.n_tokens) for r in mix.sized(d, targets).collect())
    got = weights(df)
    assert {k: w for k, w, _ in got} == pytest.approx(want, abs=1e-12) and len(got) == len(tokens)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        assert weights(df.repartition(7)) == got  # bit by bit, however the rows are laid out
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mix_of_texts_with_nulls(spark):
    docs = [(1, "some words here", "a"), (2, None, "a"), (3, "", "a"), (4, "   ", None), (5, "12 34", "b"), (5, "12 34", "b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 AS n_tokens", "2 AS weight")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    used = mix.mix(df, targets).documents.collect()
    assert {r.doc_id for r in used} <= {1, 5} and used
    assert mix.mix(df.limit(0), targets).documents.count() == 0


PROSE = "The rotator behaved as planned in heavy rain, which surprised nobody, and the crew %d moved the command to the following pass at %02d:15 UTC while we waited for %s."
SPAM = {
    1: "cheap dish sale " * 30,
    2: "\n".join(f'<a href="https://shop.x{k}.example/buy/{k}">best antenna price</a>' for k in range(20)),
    3: "#antenna #deal12 #antenna_sale " * 20,
    4: "The best feed horn is the feed horn for every feed horn buyer. Why pay more for feed horn when feed horn mast is feed horn? " * 8,
    5: "\n".join(f"SKU {k} | rotator kit | Tags: rotator kit, mast deal, rotator kit | $3{k}.99" for k in range(20)),
}
FINE = {
    11: "\n".join(f"10:{k:02d}:47 INFO: log sink rotated" for k in range(30)),
    12: "\n".join(f"CTS1+echo({k})@tssent=17496000{k:05d}@tsexec=17496000{k:05d}!" for k in range(30)),
    13: "\n".join(f"{k:02d}:05;7.{k:03d};12.41;29.49" for k in range(30)),
    14: (PROSE % (1, 2, "rain")) + " Details: https://docs.x.example/pass/74 for background. #cubesat #antenna " + (PROSE % (3, 4, "wind")),
    15: "   ",
    16: "",
    17: None,
}


def test_spam_pages(spark):
    words = "rain wind snow light night radio tower cable sensor panel".split()
    normal = [(100 + k, " ".join(PROSE % (k * 7 % 90 + j, (k + j) % 24, words[(k + j) % 10]) for j in range(1 + k % 4))) for k in range(260)]
    rows = [*SPAM.items(), *FINE.items(), *normal, (1, SPAM[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS share", "2 AS lang", "3 AS k")
    got = [r.doc_id for r in spam.suspects(df).filter("spam").collect()]
    assert sorted(got) == [1, 1, 2, 3, 4, 5]
    assert spam.suspects(df.limit(0)).count() == 0


def test_pages_joined_by_dots(spark):
    words = "rain wind snow light night radio tower cable sensor panel".split()
    normal = [(100 + k, " ".join(PROSE % (k * 7 % 90 + j, (k + j) % 24, words[(k + j) % 10]) for j in range(1 + k % 4))) for k in range(260)]
    g = random.Random(3)
    keywords = ["panel", "p4n!l", "c!nn4ct!r", "r0t@tor", "$dr", "pr!!mp", "sal!", "2026", "antenna", "4nt3nn4"]
    page = [g.choice(keywords) for _ in range(150)]
    spam_pages = {
        1: "...".join(["for", *page]),  # disguised by "!", "$" and "@"
        2: "...".join(["4nt3nn4", *page]),  # digit in the first word
        3: "...".join(["5", *page]),
        4: "--".join(["panel", *page]),
        5: "\n".join(f"p4n!l..{w}..sal!" for w in page),
    }
    fine = {
        11: "\n".join(f"rail{k}......{k}.{k % 7}" for k in range(40)),
        12: "\n".join(f"rail{k % 9}......{k}" for k in range(40)),
        13: "\n".join(f"rail{k % 9}....{k}....{k + 3}" for k in range(40)),
        14: "\n".join(f"mode{k % 9}=={k}" for k in range(40)),
        15: "\n".join(f"{k}..{k + 9}" for k in range(40)),
    }
    df = spark.createDataFrame([*spam_pages.items(), *fine.items(), *normal], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spam.suspects(df).filter("spam").collect()) == list(spam_pages)
    assert [w for w, _ in spam._read_token("p4n!l...4d4pter...pr!!mp...10:30...sal!...sdr")] == ["p4n!l", "4d4pter", "pr!!mp", "10:30", "sal!", "sdr"]


def plain_point(text, rule=spam.Rule()):
    """The features of one text, word by word."""
    from collections import Counter
    from math import log2

    rows = []
    for line in spam.re.split("[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]", text):
        own = [list(w) for m in spam._TOKEN.finditer(line) for w in spam._read_token(m.group())]
        links, rest = sum(k == spam.LINK for _, k in own), [w for w in own if w[1] == spam.WORD]
        if links and len(rest) <= rule.label_words * links and sum(w in spam.ALL_WORDS for w, _ in rest) * 4 < max(1, len(rest)):
            for w in rest:
                w[1] = spam.LABEL
        rows += own
    n = len(rows)
    if not n:
        return None
    function = [k == spam.KANA or (k == spam.WORD and w in spam.ALL_WORDS) for w, k in rows]
    content = [k in (spam.WORD, spam.LABEL) and not f and not w.isdigit() for (w, k), f in zip(rows, function)]
    shape = [spam._LEET.sub("*", w) if c and len(w) > 2 else w for (w, _), c in zip(rows, content)]
    counts = Counter(s for s, c in zip(shape, content) if c)
    often = [c and counts[s] >= rule.repeats for s, c in zip(shape, content)]
    close = [c and any(content[j] and shape[j] == s for j in range(max(0, i - rule.near), i)) for i, (s, c) in enumerate(zip(shape, content))]
    marked = [k in (spam.LINK, spam.LABEL, spam.TAG) for _, k in rows]
    stuffed = []
    for i in range(n):
        w = range(max(0, i - rule.window), min(n, i + rule.window + 1))
        fn, of, co, st = (sum(x[j] for j in w) for x in (function, often, content, [k == spam.STRUCTURED for _, k in rows]))
        stuffed.append(fn <= rule.local_function * len(w) and of >= rule.local_repeated * max(co, 1) and 2 * co >= len(w) and st <= rule.local_structured * len(w) and rows[i][1] != spam.STRUCTURED and not marked[i])
    entropy = 1.0 if n == 1 else -sum(c / n * log2(c / n) for c in Counter(shape).values()) / log2(n)
    link = sum(k in (spam.LINK, spam.LABEL) for _, k in rows)
    return [x / n for x in (link, sum(k == spam.TAG for _, k in rows), sum(stuffed), sum(function), sum(often), sum(close))] + [entropy, sum(k == spam.STRUCTURED for _, k in rows) / n]


def test_features_of_a_batch_are_those_of_each_text(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL").collect()] + [*SPAM.values(), "", "!?", "\n", "日本のカメラ", "one"]
    at, lang, values = spam.features(texts, vocabulary=spam.Vocabulary())
    want = [(i, p) for i, t in enumerate(texts) if (p := plain_point(t))]
    assert at.tolist() == [i for i, _ in want] and len(lang) == len(want)
    for got, (i, p) in zip(values.tolist(), want):
        assert got == pytest.approx(p, abs=1e-12), texts[i]
    for small in (spam.Vocabulary(limit=5), spam.Vocabulary(chars=20)):  # begun anew for nearly every text
        for i, row in zip(at, values):
            assert spam.features([texts[i]], vocabulary=small)[2][0] == pytest.approx(row, abs=1e-12)
        assert len(small) < 400


def test_statistics_of_rare_languages(spark):
    g = random.Random(4)
    rows = [("en", *[0.4 + 0.1 * g.random() for _ in spam.FEATURES]) for _ in range(2000)] + [("de", *[0.2 + 0.02 * g.random() for _ in spam.FEATURES]) for _ in range(220)]
    schema = "lang string, " + ", ".join(f"{f} double" for f in spam.FEATURES)
    centres = []
    for n in (1, 30, 199, 200, 220):
        stats = spam.statistics(spark.createDataFrame(rows[: 2000 + n], schema))
        assert set(stats) == {"all", "en", "de"}
        centres.append(stats["de"][0][0])
        whole, prior = stats["all"][0][0], spam.Rule().prior
        assert stats["de"][0][0] == pytest.approx((n * 0.21 + prior * whole) / (n + prior), abs=0.01)
    assert centres == sorted(centres, reverse=True) and centres[2] - centres[3] < 0.001  # no switch by size


def test_queries_over_empty_tables(spark, tmp_path):
    from groundlake.llm import queries

    for name in ("documents", "source_target"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
