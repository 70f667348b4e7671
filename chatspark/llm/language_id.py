"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are combined for each row: the text's likelihood under byte-trigram models,
the declared language (a document's `lang`, a page's markup), the address suffix, and the host. Host
priors are smoothed hierarchically: global over suffixes, suffix over domains, domain over hosts; each
level's counts come from grouped aggregations over all rows, with the languages that the text alone
suggests. How far a declaration can be trusted is estimated the same way, as a table of declared by
suggested language.

The trigram models are trained on labelled rows: about TRAIN_ROWS of them, those with the smallest hashes of
their id, a bound that does not depend on the input. Everything else counts all rows.

A row is rejected when no language reaches ACCEPT, or when its text isn't language at all: fewer than
MIN_LETTERS of its bytes are letters. A null or empty text has no likelihood: the other evidence decides,
and the row is rejected, for want of letters. Null declarations, hosts and suffixes are values of their
own. Ties go to the first language in name order. Repeated rows get equal results. Empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatspark.llm.seqhash import lower_ascii, text_blocks
from chatspark.llm.stage import fresh, row_key, written

TRAIN_ROWS = 8_000
SLOTS = 1 << 15
ACCEPT = 0.6
MIN_LETTERS = 0.4
#: Weight of a trigram's log likelihood (trigrams overlap and aren't independent) and of each level's parent.
TEMPER = 0.15
PSEUDO = 20.0
#: Keys of rejected rows up to this many (32 MB) are broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _slots(data: np.ndarray) -> np.ndarray:
    """Slot of the trigram that begins at each byte but the last two."""
    d = lower_ascii(data).astype(np.uint32)
    return ((d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA6B) ^ d[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)).astype(np.int64)


def train(labelled: DataFrame, label: str, text: str, order: Column) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, slot) from the bounded sample of labelled rows."""
    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    share = min(1.0, TRAIN_ROWS / max(1, rows.count()))
    sample = rows.filter(F.pmod(order, F.lit(1 << 32)) < int(share * (1 << 32))).select(F.col(label).alias("label"), F.col(text).alias("text"))

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch["label"].to_pylist()
            for at, data, offsets in text_blocks(batch["text"]):
                for i in range(len(offsets) - 1):
                    own = data[offsets[i] : offsets[i + 1]]
                    if len(own) > 2:
                        counts[labels[at + i]] = counts.get(labels[at + i], 0) + np.bincount(_slots(own), minlength=SLOTS)
        for name, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c.astype(np.int64).tobytes()], pa.binary())], names=["label", "counts"])

    total: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(run, "label string, counts binary").collect():
        total[row.label] = total.get(row.label, 0) + np.frombuffer(row.counts, np.int64)
    names = sorted(total)
    logs = [np.log((total[n] + 0.5) / (total[n].sum() + 0.5 * SLOTS)) for n in names]
    return names, np.array(logs, np.float32).reshape(len(names), SLOTS)


def _likelihoods(rows: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """Replaces `text` by `ll`, tempered log likelihoods relative to the best, and `letters`, their share of the bytes."""
    model = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes) + ", ll array<double>, letters double"

    def run(batches):
        table = model.value
        for batch in batches:
            lls, letters = [], []
            for _, data, offsets in text_blocks(batch["text"]):
                n = len(offsets) - 1
                score = np.zeros((n, table.shape[1]))
                if len(data) > 2:
                    every = table[_slots(data)]
                    total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(every, 0, dtype=np.float64)])
                    end = np.maximum(offsets[1:] - 2, offsets[:-1])
                    score = total[np.minimum(end, len(total) - 1)] - total[np.minimum(offsets[:-1], len(total) - 1)]
                score = TEMPER * (score - score.max(1, keepdims=True)) if score.size else score
                share = np.concatenate([[0], np.cumsum(_LETTER[data])])
                size = np.diff(offsets)
                lls += score.tolist()
                letters += ((share[offsets[1:]] - share[offsets[:-1]]) / np.maximum(size, 1)).tolist()
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(lls, pa.list_(pa.float64())), pa.array(letters, pa.float64())], names=[*keep, "ll", "letters"])

    return rows.select(*keep, "text").mapInArrow(run, schema)


def _smoothed(counts: list[Column], total: Column, parent: Column) -> Column:
    return F.array(*[(c + PSEUDO * parent[i]) / (total + PSEUDO) for i, c in enumerate(counts)])


def fuse(evidence: DataFrame, names: list[str]) -> DataFrame:
    """Adds detected, posterior and accepted to rows with ll, letters, declared, suffix, domain and host."""
    k = len(names)
    guess = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    base = evidence.withColumn("guess", F.when(F.col("letters") >= MIN_LETTERS, guess))
    counts = [F.sum(F.when(F.col("guess") == i, 1.0).otherwise(0.0)).alias(f"c{i}") for i in range(k)]
    named = [f"c{i}" for i in range(k)]
    hosts = written(base.groupBy("suffix", "domain", "host").agg(*counts), "hosts")
    add = [F.sum(c).alias(c) for c in named]

    totals = [float(x or 0) for x in hosts.agg(*add).first()]
    every = [(t + PSEUDO / k) / (sum(totals) + PSEUDO) for t in totals]

    def level(by: list[str], parent: DataFrame | None, out: str) -> DataFrame:
        sums = hosts.groupBy(*by).agg(*add)
        up = F.array(*[F.lit(p) for p in every])
        if parent is not None:
            shared = [c for c in by if c in parent.columns]
            joined = sums.alias("x").join(parent.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in shared])
            sums = joined.select(*[F.col(f"x.{c}") for c in [*by, *named]], F.col(f"y.{parent.columns[-1]}").alias("_up"))
            up = F.col("_up")
        total = sum(F.col(c) for c in named)
        return sums.select(*by, _smoothed([F.col(c) for c in named], total, up).alias(out))

    by_suffix = level(["suffix"], None, "p_suffix")
    by_domain = level(["suffix", "domain"], by_suffix, "p_domain")
    by_host = written(level(["suffix", "domain", "host"], by_domain, "p_host"), "priors")
    trust = written(base.groupBy("declared").agg(*counts), "trust")
    kinds = trust.count()
    trust = trust.select(F.col("declared").alias("_declared"), F.array(*[F.log((F.col(c) + 1.0) / F.lit(t + float(kinds))) for c, t in zip(named, totals)]).alias("_trust"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("suffix", "domain", "host")]
    priors = by_host.select(*[F.col(c).alias(f"_{c}") for c in ("suffix", "domain", "host")], "p_host")
    joined = evidence.join(priors, on, "left").join(trust, F.col("declared").eqNullSafe(F.col("_declared")), "left")
    logs = [F.col("ll")[i] + F.col("_trust")[i] + F.log(F.col("p_host")[i]) for i in range(k)]
    joined = joined.withColumn("_log", F.array(*logs))
    joined = joined.withColumn("_exp", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    best = F.array_position("_log", F.array_max("_log")).cast("int") - 1
    posterior = 1.0 / F.aggregate("_exp", F.lit(0.0), lambda a, x: a + x)
    out = joined.withColumn("detected", F.array(*[F.lit(n) for n in names])[best]).withColumn("posterior", posterior)
    out = out.withColumn("accepted", (F.col("posterior") >= ACCEPT) & (F.col("letters") >= MIN_LETTERS))
    return out.drop("_log", "_exp", "_trust", "_declared", "p_host", *[f"_{c}" for c in ("suffix", "domain", "host")])


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents have no address: their source is the host, its letters without digits the domain."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("lang").cast("string").alias("declared"),
        none.alias("suffix"), F.regexp_replace(F.col("source").cast("string"), "[0-9]+$", "").alias("domain"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Host, domain and suffix of the address, language of the html tag, and the markup without its tags."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    html = F.col("html").cast("string")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return pages.select(
        F.lit("pages").alias("origin"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
        F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html[^>]*\blang\s*=\s*["']?([a-zA-Z]+)""", 1)), F.lit("")).alias("declared"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), host.alias("host"), text.alias("text"),
    )


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """origin, doc_id, page_id, declared, detected, posterior, letters, accepted for rows of evidence."""
    names, logs = model
    if not names:
        return rows.select("origin", "doc_id", "page_id", "declared", F.lit(None).cast("string").alias("detected"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("letters"), F.lit(False).alias("accepted"))
    thin = written(_likelihoods(rows, names, logs), "likelihoods")
    return fuse(thin, names).select("origin", "doc_id", "page_id", "declared", "detected", "posterior", "letters", "accepted")


def document_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Trained on documents whose `lang` is given."""
    return train(docs, "lang", "text", F.xxhash64(F.col("doc_id").cast("long"), F.lit("train")))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that language identification doesn't reject, with all their columns."""
    evidence = document_evidence(docs)
    names, logs = document_model(docs)
    if not names:
        return docs.filter("false")
    evidence = evidence.withColumn("row", row_key(*[F.col(c) for c in ("doc_id", "declared", "host", "text")]))
    found = fuse(written(_likelihoods(evidence, names, logs), "likelihoods"), names)
    gone = fresh(docs.columns, "gone")
    rejected = written(found.filter("not accepted").select(F.col("row").alias(gone)).distinct(), "gone")
    if rejected.count() <= MAX_BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    own = row_key(docs["doc_id"].cast("long"), docs["lang"], docs["source"], docs["text"])
    return docs.join(rejected, own == F.col(gone), "left_anti")
