"""Secret scan with a random forest that removes false positives.

Candidates are long tokens (MIN_CHARS or more of letters, digits and the marks of base64 and of names)
that hold a digit or change case inside, every value, of any length and marks, that follows the name of a
credential, and passwords within addresses. Candidates are found in time that grows with the text's length, however it is made. A token `name=value` counts by its value. Each has features of five kinds: its length and character classes,
how likely its character transitions are in the corpus' own words, the share of it that dictionary words
cover, its path (the source: its parts, and how many candidates its documents have), and its neighbouring words. A random forest trained on labelled findings
scores every candidate.

Transitions and dictionary are counts over all documents. The dictionary is the DICTIONARY words with the
highest counts, a fixed bound on what is sent to the executors. The forest is fitted on about TRAIN_ROWS labelled findings, those with the
smallest hashes; that bound does not depend on the input. Where no labelled findings are given, rules label
the candidates that they are sure of: a random-looking value after an assignment to a name of a credential is a
secret; addresses, links, numbers and words are not.

Null or empty texts have no candidates; a document may have many, one row each, equal ones included (their
places differ). Repeated rows give repeated findings. Without labelled findings of both kinds no forest can be
fitted, and the score is the rules' own (1 for what they are sure of, else 0). Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.stage import written

MIN_CHARS = 16
#: Candidates that leave a task at a time.
OUT_ROWS = 4096
DICTIONARY = 20_000
TRAIN_ROWS = 20_000
THRESHOLD = 0.5
TREES = 24
DEPTH = 6
#: Paths up to this many are broadcast with their rates; more are joined by shuffle.
MAX_BROADCAST_PATHS = 200_000
SEED = 7
_CANDIDATE = re.compile(rf"[A-Za-z0-9_\-+/=.@]{{{MIN_CHARS},}}")
_WORDS = re.compile(r"[A-Za-z]{3,}")
_TOKENS = re.compile(r"[A-Za-z0-9_]+")
#: Names that a credential is assigned to.
NAMES = frozenset("token secret password passwd pwd apikey api_key key auth credential credentials access_key private_key bearer".split())
#: Names that are sure of a credential as a part of a longer name, as in DB_PASSWORD; a `key` may be any.
SURE = NAMES - {"key", "auth"}
_JOINED = "|".join(sorted(NAMES, key=len, reverse=True))
#: A credential's name or the end of a name from it on, what parts it from the value, and the value: quoted, or up to a space, a
#: mark that parts assignments, or the next assignment to a credential. So values of unquoted assignments don't overlap.
_NAMED = re.compile(
    rf"(?i)(?:{_JOINED})(?P<rest>[a-z0-9_.\-]{{0,60}}?)"
    r"""(?P<gap>["'\])}]{0,3}(?:[ \t]*(?:=>|:=|==?|:)[ \t]*|[ \t]+(?:is|was)[ \t]+|[ \t]+)(?:bearer[ \t]+|basic[ \t]+)?)"""
    r"""(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|`(?P<back>[^`\n]+)`|(?P<bare>[^\s"'`&;,]"""
    rf"""(?:(?!(?:{_JOINED})[a-z0-9_.\-]{{0,60}}[=:])[^\s"'`&;,])*))"""
)
#: What stands between an address' scheme and its host: a user and a password.
_LOGIN = re.compile(r"://[^\s/:@]*:(?P<value>[^\s/@]+)@")
_LOGIN_BEFORE = re.compile(r"://[^\s/:@]*:$")
_ASSIGNED = re.compile(r"""([A-Za-z0-9_.\-]+)["'\])}]{0,3}\s*(?:=>|:=|==?|:)\s*(?:[Bb]earer\s+|[Bb]asic\s+)?["'`]?$""")
_NAME_OF_TOKEN = re.compile(r"(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)=+(?=[^=])")
_PARTS = re.compile(r"[^a-z0-9]+")
_LETTERS = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the lower-case ASCII words of all texts."""

    def run(batches):
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch["text"]:
                if text.is_valid:
                    counts.update(text.as_buffer().to_pybytes().translate(_LETTERS).split())
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def transitions(counts: DataFrame) -> np.ndarray:
    """Log probabilities of the character after each character, from word counts; 27 by 27 with the word's end."""
    pairs = counts.filter("length(word) < 40").select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.concat("word", F.lit(" ")), i, F.lit(2)))).alias("pair"))
    table = np.ones((27, 27))
    index = lambda c: 26 if c == " " else ord(c) - 97
    for row in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 27 * 26 rows at most
        table[index(row.pair[0]), index(row.pair[1])] += row.n
    return np.log(table / table.sum(1, keepdims=True))


def features(value: str, before: str, after: str, source: str, table: np.ndarray, words: frozenset[str]) -> list[float]:
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    upper = sum(c.isupper() for c in value)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in value)
    letters = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in value.lower()]
    steps = [table[a, b] for a, b in zip(letters, letters[1:]) if a < 26]
    covered = sum(len(w) for w in _WORDS.findall(value) if w.lower() in words)
    share = Counter(value)
    entropy = -sum(k / n * np.log2(k / n) for k in share.values())
    assigned = _ASSIGNED.search(before)
    left, right = _TOKENS.findall(before)[-3:], _TOKENS.findall(after)[:3]
    name = assigned[1] if assigned else (left or [""])[-1]
    known = lambda some: sum(w.lower() in words for w in some) / len(some) if some else -1.0
    path = _TOKENS.findall(source)
    return [
        float(n), digits / n, upper / n, hexa / n, (sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))) / n, float(entropy),
        float(np.mean(steps)) if steps else -6.0, covered / n, value.count("/") / n, value.count(".") / n, float("@" in value), float(value.count("-") + value.count("_")) / n,
        float(credential(name, NAMES)), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before.endswith(('"', "'")) and after[:1] in ('"', "'")),
        known(left[-1:]), known(left), known(right[:1]), known(right), float("\n" in before[-20:]), float("\n" in after[:20]),
        float(len(path)), float(source.count("/")), known(path), sum(c.isdigit() for c in source) / max(1, len(source)),
    ]


def credential(name: str, names: frozenset[str]) -> bool:
    """Whether a name, or a part of it between marks or capitals, is one of `names`."""
    low = name.lower().strip("_.-")
    if low in NAMES or low.replace("-", "_") in NAMES:
        return True
    parts = _PARTS.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    return not names.isdisjoint(parts) or not names.isdisjoint(f"{a}_{b}" for a, b in zip(parts, parts[1:]))


def rule_label(value: str, before: str) -> int | None:
    """1 or 0 where the rules are sure of a candidate, else None."""
    assigned = _ASSIGNED.search(before)
    named = bool(assigned) and credential(assigned[1], SURE)
    address = "://" in value or re.fullmatch(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+", value) is not None
    if named and not address:
        return 1 if sum(c.isdigit() for c in value) >= 3 else None
    if _LOGIN_BEFORE.search(before):
        return 1 if any(c.isdigit() for c in value) else None
    if "@" in value or "://" in value or re.fullmatch(r"[A-Za-z.\-]+|[\d.\-+/]+", value):
        return 0
    return None


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a text, in order."""
    found = set()
    at = 0
    while m := _NAMED.search(text, at):
        kind = next(k for k in ("double", "single", "back", "bare") if m[k] is not None)
        at = m.start() + 1
        if not re.search(r"[=:]", m["gap"]) and (m["rest"].lower() not in ("", "s") or text[m.start() - 1 : m.start()].isalnum()):
            continue  # within running text only whole words are names
        value = m[kind] if kind != "bare" else m[kind].rstrip(",;)]}>.") or m[kind]
        found.add((m.start(kind), m.start(kind) + len(value)))
    found.update(m.span("value") for m in _LOGIN.finditer(text))
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while (name := _NAME_OF_TOKEN.match(text, start, end)) and (end - name.end() >= MIN_CHARS or credential(name["name"], NAMES)):
            start = name.end()
        whole = text[start:end]
        value = whole.strip(".=-")
        inner = value.swapcase()[1:]
        if len(value) < MIN_CHARS or not (any(c.isdigit() for c in value) or not (inner.isupper() or inner.islower())):
            continue
        start += whole.find(value)
        found.add((start, start + len(value)))
    return sorted(found)


def _candidates(docs: DataFrame, table: np.ndarray, words: frozenset[str]) -> DataFrame:
    """doc_id, source, start, length, value, label, features of each candidate of each document."""
    model = docs.sparkSession.sparkContext.broadcast((table, words))
    schema = "doc_id long, source string, start long, length long, value string, label int, features array<double>"

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        table, words = model.value
        for batch in batches:
            rows = []
            for doc_id, text, source in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["source"].to_pylist()):
                for start, end in places(text or ""):
                    value = text[start:end]
                    before, after = text[max(0, start - 40) : start], text[start + len(value) : start + len(value) + 20]
                    rows.append((doc_id, source, start, len(value), value, rule_label(value, before), features(value, before, after, source or "", table, words)))
                    if len(rows) == OUT_ROWS:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, schema)


def _with_path(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates with a last feature, how many of them a document of their path has: logs and listings have many."""
    source = F.col("source").cast("string").alias("source")
    rates = docs.select(source, F.lit(0).alias("n")).unionByName(found.select("source", F.lit(1).alias("n"))).groupBy("source").agg((F.sum("n") / F.greatest(F.lit(1), F.count(F.lit(1)) - F.sum("n"))).alias("rate"))
    rates = written(rates, "paths").select(F.col("source").alias("_source"), "rate")
    if rates.count() <= MAX_BROADCAST_PATHS:
        rates = F.broadcast(rates)
    joined = found.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("features", F.concat("features", F.array(F.log1p("rate")))).drop("_source", "rate", "source")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start (in code points), length, value_sha256, score, is_secret for each candidate.

    `labelled` has doc_id, start and label (0 or 1) of findings; without it the rules label what they are sure of.
    """
    spark = docs.sparkSession
    counts = written(word_counts(docs), "words")
    words = frozenset(r.word for r in counts.filter("length(word) between 3 and 40").orderBy(F.desc("n"), "word").limit(DICTIONARY).collect())
    found = written(_with_path(written(_candidates(docs, transitions(counts), words), "found"), docs), "candidates")
    known = found.filter("label is not null") if labelled is None else found.drop("label").join(labelled.select("doc_id", "start", F.col("label").cast("int").alias("label")), ["doc_id", "start"])
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", "start", "value"), F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = known.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    sample = written(sample.select("label", vector_to_array("features").alias("features")), "labelled").select("label", array_to_vector("features").alias("features"))
    kinds = {r.label for r in sample.select("label").distinct().collect()}
    out = found.withColumn("value_sha256", F.sha2("value", 256))
    if kinds == {0.0, 1.0}:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(sample)
        out = forest.transform(out.withColumn("features", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    else:
        out = out.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    return out.select("doc_id", "start", "length", "value_sha256", F.round("score", 9).alias("score"), (F.col("score") >= THRESHOLD).alias("is_secret"))
