"""Keyword-stuffed and link-list pages (problem 9).

Each text becomes a point of features: densities of links, of tags and of words amid repeated keywords, function-word
ratio, repetition of content words in the text and close by, entropy of words, and share of structured tokens (clock
times, numbers in columns, commands). Per language, location and scale are median and median absolute deviation over all
documents, and the correlation of the winsorised points gives a robust Mahalanobis distance.

A text is flagged if it is an outlier and its whitened deviation points in spam-directed directions: the length of its
part towards more links, tags or keywords, plus that towards fewer function words, more repetition and less entropy,
less three times what points towards more structure. So logs, plans and tables are outliers of another direction, and
neither a few tags in prose nor repetition alone make a page spam. Nothing else decides.

Language comes from script and function words, not from the declared one, which may be wrong; texts that show none
are held against the statistics of all texts. Those of each language are drawn towards these as if ``prior`` more
texts had them, so a rare language has statistics of its own in proportion to its count and no size switches them.

Statistics are aggregates over all documents (percentile sketches and sums, combined on the map side). The driver
sees one row of them a language, of which there are six. A batch of texts is one array of words: each distinct token is
read once a worker, the rest is NumPy over all words of the batch.

Defined results: null, empty and blank texts are no cases and take no part in statistics; repeated rows are judged
alike; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundlake.llm.words import ALL_WORDS, WORDS_OF
from groundlake.session import written

FEATURES = ("link", "tag", "stuffed", "function", "repeated", "close", "entropy", "structured")
#: which way each feature points for spam
DIRECTION = np.array([1.0, 1.0, 1.0, -1.0, 1.0, 1.0, -1.0, -1.0])
DENSITY, WORDING, STRUCTURE = slice(0, 3), slice(3, 7), 7
#: least scale of each feature, as many texts have none of it at all
FLOOR = np.array([0.03, 0.03, 0.03, 0.04, 0.06, 0.05, 0.03, 0.03])

_TOKEN = re.compile(
    r"(?P<plain>[A-Za-z0-9À-ÖØ-öø-ɏ]++(?=[,.;:!?)]*+(?:\s|\Z)))"  # most words, told apart without a look at the rest
    r"|(?P<anchor></?[aA]\b[^>\n\r]*>)"
    r"|(?P<link>(?:[hH][tT]{2}[pP][sS]?://|[wW]{3}\.)[^\s)\]>]+|[\w–-]+(?:\.[\w–-]+)+/[^\s)\]>]*)"
    r"|(?P<tag>#\w+)"
    r"|(?P<price>[$€£][ \t]?\d[\d.,]*)"
    r"|(?P<cjk>[぀-ヿ㐀-鿿豈-﫿])"
    r"|(?P<word>[^\W_]+(?:[.:,'’=@+/()_!$-]+[^\W_]+)*)"
    r"|(?P<line>[\n\r\v\f\x1c-\x1e\x85\u2028\u2029])",
)
_FIND = re.compile(re.sub(r"\?P<\w+>", "?:", _TOKEN.pattern)).findall
_PARTS = re.compile(r"[^\W_]+(?:['’!$@][^\W_]+)*")
_STRUCTURED = re.compile(r"\d.*[:.=(/+-]|[:.=(/+-].*\d|^[0-9a-f]{2}$|^(?=.*\d)[0-9a-f]{6,}$", re.IGNORECASE)
_LEET = re.compile(r"[aeiouäöüáéíóúàèâêîôûy0-9!@$]")
_DOTTED = re.compile(r"[^\W\d_]+(?:\.{2,}[^\W_]+)+")
#: repeated separators, which join words to one token; runs of different ones belong to commands
_RUN = re.compile(r"\.{2,}|-{2,}|:{2,}|,{2,}|={2,}|\+{2,}|/{2,}|_{2,}")
#: a word of such a chain, where "!", "$" and "@" stand for letters at its ends and in a row too
_LINKED = re.compile(r"(?:[^\W_]|['’!$@])+")
_LANGUAGES = tuple(WORDS_OF)
LINK, TAG, STRUCTURED, KANA, WORD, LABEL, LINE = range(7)


@dataclass(frozen=True)
class Rule:
    distance: float = 6.0  # least robust distance of an outlier
    directed: float = 16.5  # least length in spam-directed directions; many scales are at their floor, so it is large
    against: float = 3.0  # weight of more structure than usual, which points the other way
    window: int = 8  # words to either side
    local_function: float = 0.25
    local_repeated: float = 0.6
    local_structured: float = 0.12
    repeats: int = 3
    near: int = 24
    label_words: int = 12  # most words of a label a link
    prior: int = 50


def _chain(value: str) -> list[str] | None:
    """The parts of words joined by repeated separators; None for other tokens.

    A name and its number ("rail1....23") are a row of a table, and pairs with other separators than dots are code:
    most parts must hold letters, and without dots there must be three.
    """
    parts = _RUN.split(value)
    if len(parts) < 2 or (len(parts) == 2 and ".." not in value):
        return None
    lettered = sum(any(map(str.isalpha, p)) for p in parts)
    return parts if lettered * 2 > len(parts) or _DOTTED.fullmatch(value) else None


def _words_of(value: str) -> list[tuple[str, int]]:
    """The words of a word token and their kinds."""
    if value.isalpha():
        return [(value.lower(), WORD)]
    if parts := _chain(value):
        out: list[tuple[str, int]] = []
        for part in parts:
            if _STRUCTURED.search(part) and not part.isalpha():
                out.append((part, STRUCTURED))
            else:
                out += [(w.strip("'’"), WORD) for w in _LINKED.findall(part.lower()) if any(map(str.isalnum, w))]
        return out
    if _STRUCTURED.search(value):
        return [(value, STRUCTURED)]
    return [(w, WORD) for w in _PARTS.findall(value.lower())]


def _read_token(value: str) -> list[tuple[str, int]]:
    kind = _TOKEN.fullmatch(value).lastgroup
    if kind == "anchor":
        return [] if value[1] == "/" else [(value, LINK)]
    if kind == "link":
        return [(value, LINK)]
    if kind == "tag":
        return [(re.sub(r"[\d_]", "", value.lower()), TAG)]
    if kind == "cjk":
        return [(value, KANA if "぀" <= value <= "ゟ" else WORD)]
    if kind in ("plain", "word"):
        return _words_of(value)
    return [("\n", LINE)] if kind == "line" else []


class Vocabulary(dict):
    """Distinct tokens of a Python worker, each read once: token -> number. What a token says stands in arrays by number.

    ``limit`` bounds the tokens and ``chars`` their characters; a fuller one is begun anew between two batches.
    """

    def __init__(self, limit: int = 500_000, chars: int = 20_000_000) -> None:
        super().__init__()
        self.limit, self.chars, self.held = limit, chars, 0
        self.strings: dict[str, int] = {}
        self.first, self.count = [], []  # by token: its words
        self.kind, self.word, self.shape, self.digit, self.languages = [], [], [], [], []  # by word

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.held += len(token)
        words = _read_token(token)
        self.first.append(len(self.kind))
        self.count.append(len(words))
        for w, kind in words:
            self.kind.append(kind)
            self.word.append(self.strings.setdefault(w, len(self.strings)))
            shape = _LEET.sub("*", w) if len(w) > 2 else w  # vowels and what stands in for them made equal
            self.shape.append(self.strings.setdefault(shape, len(self.strings)))
            self.digit.append(w.isdigit())
            self.languages.append(sum(1 << i for i, k in enumerate(_LANGUAGES) if w in WORDS_OF[k]))
        return number

    def read(self, texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(words a text with line ends, columns of all words in order)."""
        if len(self) > self.limit or self.held > self.chars:
            self.clear()
            self.__init__(self.limit, self.chars)
        tokens: list[int] = []
        lengths = []
        for text in texts:
            found = _FIND(text)
            tokens += map(self.__getitem__, found)
            lengths.append(len(found))
        at = np.asarray(tokens, np.int64)
        count = np.asarray(self.count, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(count))
        places = np.repeat(np.asarray(self.first, np.int64)[at] - ends[:-1], count) + np.arange(ends[-1]) if len(at) else at
        columns = {name: np.asarray(getattr(self, name), kind)[places] if len(places) else np.zeros(0, kind) for name, kind in (("kind", np.int8), ("word", np.int64), ("shape", np.int64), ("digit", bool), ("languages", np.int8))}
        of = np.append(0, np.cumsum(lengths))
        return ends[of[1:]] - ends[of[:-1]], columns


@lru_cache(maxsize=1)
def _vocabulary() -> Vocabulary:
    return Vocabulary()


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, values, minlength=n)


def features(texts: list[str], rule: Rule = Rule(), vocabulary: Vocabulary | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(places of texts with words, their languages, features by text), all texts of a batch together."""
    lengths, c = (vocabulary or _vocabulary()).read(texts)
    text = np.repeat(np.arange(len(texts)), lengths)
    ends = c["kind"] == LINE
    line = (text + np.cumsum(ends))[~ends]  # new at every line end and text
    text, kind, word, shape, digit, languages = text[~ends], *(c[k][~ends] for k in ("kind", "word", "shape", "digit", "languages"))
    if not len(text):
        return np.zeros(0, np.int64), [], np.zeros((0, len(FEATURES)))
    n_texts, known = len(texts), languages != 0
    # a link's label: the few other words of its line, if they make no sentence
    lines = int(line[-1]) + 1
    plain = kind == WORD
    links, rest, functions = (_sums(x, line, lines) for x in (kind == LINK, plain, plain & known))
    label = (links > 0) & (rest <= rule.label_words * links) & (functions * 4 < np.maximum(1, rest))
    kind = np.where(plain & label[line], LABEL, kind)
    size = np.bincount(text, minlength=n_texts)
    n = np.maximum(size, 1)
    function = (kind == KANA) | ((kind == WORD) & known)
    content = ((kind == WORD) | (kind == LABEL)) & ~function & ~digit
    shape = np.where(content, shape, word)
    # occurrences of each shape in each text, in order
    key = text * (int(shape.max()) + 1) + shape
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group)
    share = total / n[text[order][new]]
    entropy = -_sums(share * np.log2(share), text[order][new], n_texts) / np.log2(np.maximum(2, n))
    entropy[size == 1] = 1.0  # one word repeats nothing
    wordy = order[content[order]]
    new = np.append(True, key[wordy][1:] != key[wordy][:-1]) if len(wordy) else np.zeros(0, bool)
    often, close = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(wordy):
        often[wordy] = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] >= rule.repeats
        close[wordy] = ~new & (np.diff(wordy, prepend=-rule.near - 1) <= rule.near)
    structured = kind == STRUCTURED
    # words in surroundings of repeated keywords: sums over windows by prefix sums
    first = np.append(0, np.cumsum(size))[:-1][text]
    at = np.arange(len(text))
    a, z = np.maximum(first, at - rule.window), np.minimum(first + size[text], at + rule.window + 1)
    window = lambda x: (p := np.append(0, np.cumsum(x)))[z] - p[a]
    fn, of, co, st = map(window, (function, often, content, structured))
    width = z - a
    stuffed = (fn <= rule.local_function * width) & (of >= rule.local_repeated * np.maximum(co, 1)) & (co * 2 >= width) & (st <= rule.local_structured * width) & ~structured
    linked, tagged = (kind == LINK) | (kind == LABEL), kind == TAG
    marked = linked | tagged
    columns = [_sums(x, text, n_texts) / n for x in (linked, tagged, stuffed & ~marked, function, often, close)] + [entropy, _sums(structured, text, n_texts) / n]
    # by script and function words, "all" if nothing tells
    hits = np.stack([_sums((languages >> i) & 1, text, n_texts) for i in range(len(_LANGUAGES))], axis=1)
    best = hits.argmax(axis=1)
    most = hits[np.arange(n_texts), best]
    names = np.where((most >= 3) & (most >= 0.05 * n), np.array(_LANGUAGES)[best], "all")
    names = np.where(_sums(kind == KANA, text, n_texts) > 0.1 * n, "ja", names)
    there = np.flatnonzero(size)
    return there, names[there].tolist(), np.stack(columns, axis=1)[there]


def _portions(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``chars`` characters, so that memory follows neither the batch nor its longest texts."""
    begun = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield begun, texts[begun:i]
            begun, size = i, 0
        size += len(text)
    if begun < len(texts):
        yield begun, texts[begun:]


_POINTS = "k {kind}, lang string, " + ", ".join(f"{f} double" for f in FEATURES)


def points(df: DataFrame, key: str, text: str, rule: Rule = Rule()) -> DataFrame:
    """(k, lang, features...) of texts that are not blank."""
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).filter(r"text RLIKE '\\S'")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _portions(b.column(1).to_pylist()):
                at, lang, f = features(texts, rule)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + first)), pa.array(lang, pa.string()), *map(pa.array, f.T)], ["k", "lang", *FEATURES])

    return rows.mapInArrow(run, _POINTS.format(kind=kind))


def statistics(found: DataFrame, rule: Rule = Rule()) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{language: (median, scale, whitening matrix)}; "all" is over every text. At most six rows come to the driver."""
    each = found.withColumn("g", F.explode(F.array_distinct(F.array("lang", F.lit("all")))))
    mid = each.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 2000).alias(f) for f in FEATURES]).collect()
    own = {r["g"]: np.array([r[f] for f in FEATURES]) for r in mid}
    if not own:
        return {}
    weight = {r["g"]: 1.0 if r["g"] == "all" else r["n"] / (r["n"] + rule.prior) for r in mid}
    drawn = lambda values: {g: weight[g] * v + (1 - weight[g]) * values["all"] for g, v in values.items()}
    centre = drawn(own)
    away = [F.abs(F.col(f) - _by_language({g: float(c[j]) for g, c in own.items()})) for j, f in enumerate(FEATURES)]
    spread = each.groupBy("g").agg(*[F.percentile_approx(a, 0.5, 2000).alias(f) for a, f in zip(away, FEATURES, strict=True)]).collect()
    scale = drawn({r["g"]: np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), FLOOR) for r in spread})
    z = [F.least(F.lit(2.5), F.greatest(F.lit(-2.5), (F.col(f) - _by_language({g: float(c[j]) for g, c in centre.items()})) / _by_language({g: float(s[j]) for g, s in scale.items()}))) for j, f in enumerate(FEATURES)]
    k = len(FEATURES)
    sums = each.groupBy("g").agg(*[F.avg(z[i] * z[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], *[F.avg(z[i]).alias(f"a{i}") for i in range(k)]).collect()
    correlations = {}
    for r in sums:
        mean = np.array([r[f"a{i}"] for i in range(k)])
        cov = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        # correlations shrunk by a third, so that no direction is lost and the matrix is well conditioned
        correlations[r["g"]] = (2 * cov / np.outer(sd, sd) + np.eye(k)) / 3
        np.fill_diagonal(correlations[r["g"]], 1.0)
    out = {}
    for g, correlation in drawn(correlations).items():
        value, vector = np.linalg.eigh(correlation)
        out[g] = (centre[g], scale[g], vector @ np.diag(np.maximum(value, 0.1) ** -0.5) @ vector.T)
    return out


def _by_language(values: dict[str, float]):
    out = F.lit(values["all"])
    for g, v in values.items():
        if g != "all":
            out = F.when(F.col("g") == g, F.lit(v)).otherwise(out)
    return out


def scores(values: np.ndarray, lang: list[str], stats: dict, rule: Rule = Rule()) -> tuple[np.ndarray, np.ndarray]:
    """(Mahalanobis distance, length of the deviation in spam-directed directions)."""
    toward = np.zeros(values.shape)
    names = np.asarray(lang, dtype=object)
    for g in set(lang):
        centre, scale, white = stats.get(g) or stats["all"]
        own = names == g
        toward[own] = ((values[own] - centre) / scale) @ white.T * DIRECTION
    length = lambda part: np.sqrt((np.maximum(toward[:, part], 0) ** 2).sum(axis=1))
    directed = length(DENSITY) + length(WORDING) - rule.against * np.maximum(0, -toward[:, STRUCTURE])
    return np.sqrt((toward**2).sum(axis=1)), directed


def suspects(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, lang, distance, directed, spam) of every text that is not blank."""
    found = written(points(df, key, text, rule), "spam-points")
    stats = statistics(found, rule)
    kind = found.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([b.column(2 + j).to_numpy() for j in range(len(FEATURES))], axis=1)
            distance, directed = scores(values, b.column(1).to_pylist(), stats, rule)
            spam = (distance > rule.distance) & (directed > rule.directed)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(distance), pa.array(directed), pa.array(spam)], ["k", "lang", "distance", "directed", "spam"])

    return found.mapInArrow(run, f"k {kind}, lang string, distance double, directed double, spam boolean").withColumnRenamed("k", key)
