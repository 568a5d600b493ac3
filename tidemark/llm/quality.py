"""Host-level quality rules.

Documents are measured one by one; failures of each rule are added up by host; a host's failure rate of each rule is shrunk
towards all hosts by a beta prior fitted to the hosts themselves; the host's verdict goes back to its documents: rules that
the host fails often are stricter for them, and a host that fails nearly always loses all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, arrow_batches, col, fresh, join_checked, materialize

MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
#: Limits of the rules beyond the base ones: symbols a word, repeated lines a line, mean word length.
MAX_SYMBOLS = 0.2
MAX_DUP_LINES = 0.5
MAX_MEAN_WORD = 25.0
#: A host whose shrunk failure rate of one of those rules is above STRICT_RATE halves the rule's limit for its documents. A
#: host that fails any rule at a rate above BLOCK_RATE, even two standard deviations below its rate, loses all documents.
STRICT_RATE = 0.4
BLOCK_RATE = 0.9
#: Prior strength in documents: bounds of the fit.
WEAKEST, STRONGEST = 2.0, 2_000.0

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; a null text measures as an empty one."""
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, reach = Counter(windows), 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    lines = text.split("\n")
    again, met = 0, set()
    if len(set(lines)) < len(lines):
        for line in lines:
            if line in met:
                again += WORD.search(line) is not None
            met.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeated, len(lines)


def measure_documents(docs: DataFrame, names: tuple[str, ...] = MEASURES, text: str = "text") -> DataFrame:
    """docs with MEASURES as long columns under ``names``."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(at).to_pylist()]
            yield batch, [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names)

    return append_columns(docs, run, [T.StructField(name, T.LongType()) for name in names])


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] > MAX_REPEAT_SHARE * m["n_words"])


#: Rules in the order of their failure counts: the base ones, those with a limit of their own, and any of them.
LIMITED = ("symbols", "dup_lines", "long_words")
RULES = ("short", "repeated", *LIMITED, "any")


def shares(m: dict[str, Column]) -> dict[str, Column]:
    """How near a document is to the limit of each further rule: above 1 it fails."""
    words = F.greatest(m["n_words"], F.lit(1))
    return {
        "symbols": m["n_symbols"] / words / MAX_SYMBOLS,
        "dup_lines": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)) / MAX_DUP_LINES,
        # Half the limit is no sign of junk for word lengths: below the limit a share counts half.
        "long_words": m["word_chars"] / words / MAX_MEAN_WORD / 2 + F.when(m["word_chars"] / words > MAX_MEAN_WORD, F.lit(1.0)).otherwise(F.lit(0.0)),
    }


def failures(m: dict[str, Column]) -> dict[str, Column]:
    """Whether a document fails each of RULES."""
    found = {"short": m["n_words"] < MIN_WORDS, "repeated": m["n_repeat_words"] > MAX_REPEAT_SHARE * m["n_words"]} | {k: v > 1 for k, v in shares(m).items()}
    return found | {"any": reduce(lambda a, b: a | b, found.values())}


def fitted_strength(mean: float, spread: float, hosts: int, docs: int) -> float:
    """Strength, in documents, of the beta prior whose mean is that of all documents: from the spread of the hosts' rates
    beyond what binomial noise explains. With a single host, or no such spread, it is the strongest allowed."""
    if not docs or not 0 < mean < 1 or hosts < 2:
        return STRONGEST
    noise = mean * (1 - mean) * hosts / docs
    return min(STRONGEST, max(WEAKEST, mean * (1 - mean) / (spread - noise) - 1)) if spread > noise else STRONGEST


def host_verdicts(measured: DataFrame, host: str, m: dict[str, Column]) -> DataFrame:
    """(host, host_docs, host_rate, strict_rules, host_verdict) of every host.

    ``host_rate`` is its shrunk rate of failing any rule, ``strict_rules`` those of LIMITED whose shrunk rate is above
    STRICT_RATE, ``host_verdict`` blocked, strict (there is such a rule) or open. A rule's prior is beta(mean * strength,
    (1 - mean) * strength), see ``fitted_strength``.
    """
    failed = failures(m)
    hosts = materialize(measured.groupBy(F.coalesce(col(host), F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.count_if(failed[r]).alias(f"failed_{r}") for r in RULES]), "hosts")
    total = hosts.agg(F.sum("host_docs").alias("n"), F.count(F.lit(1)).alias("h"), *[F.sum(f"failed_{r}").alias(r) for r in RULES]).first()
    mean = {r: total[r] / total["n"] if total["n"] else 0.0 for r in RULES}
    rate = {r: F.col(f"failed_{r}") / F.col("host_docs") for r in RULES}
    spread = hosts.agg(*[(F.sum(F.col("host_docs") * (rate[r] - mean[r]) ** 2) / F.lit(max(1, total["n"] or 0))).alias(r) for r in RULES]).first()
    strength = {r: fitted_strength(mean[r], spread[r] or 0.0, total["h"], total["n"]) for r in RULES}
    shrunk = {r: (F.col(f"failed_{r}") + F.lit(mean[r] * strength[r])) / (F.col("host_docs") + F.lit(strength[r])) for r in RULES}
    error = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("host_docs") + F.lit(strength["any"] + 1)))
    strict = F.array_compact(F.array(*[F.when(shrunk[r] > STRICT_RATE, F.lit(r)) for r in LIMITED]))
    verdict = F.when(F.col("host_rate") - 2 * error > BLOCK_RATE, "blocked").when(F.size("strict_rules") > 0, "strict").otherwise("open")
    return hosts.withColumns({"host_rate": shrunk["any"], "strict_rules": strict}).withColumn("host_verdict", verdict).select("host", "host_docs", "host_rate", "strict_rules", "host_verdict")


def judge(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, host, the measures, base_failed, host_docs, host_rate, strict_rules, host_verdict, kept.

    A null text measures as empty and fails; null hosts form one host named ''; repeated rows are judged alike, each on
    its own row. Measures are made once and written, since they feed the hosts and the verdicts. Very long texts are measured
    whole; an empty table gives no rows; columns beside the three named are not read.
    """
    bare = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(host).cast("string"), F.lit("")).alias("host"), col(text).alias("text"))
    measured = materialize(measure_documents(bare).drop("text"), "measures")
    m = {k: F.col(k) for k in MEASURES}
    hosts = materialize(host_verdicts(measured, "host", m), "host-verdicts")
    judged = join_checked(measured, hosts, ["host"], "left")
    return judged.withColumn("base_failed", base_failed(m)).withColumn("kept", _kept(m, F.col("host_verdict"), F.col("strict_rules")))


def _kept(m: dict[str, Column], verdict: Column, strict: Column) -> Column:
    within = [share <= F.when(F.array_contains(strict, rule), 0.5).otherwise(1.0) for rule, share in shares(m).items()]
    return reduce(lambda a, b: a & b, within, ~base_failed(m) & (verdict != "blocked"))


def filter_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs.

    Texts are measured twice instead of shuffled: once for the hosts, once beside the whole row for its verdict. Nulls,
    repeated rows, very long texts (measured whole) and empty tables are as in ``judge``; other columns stay.
    """
    bare = docs.select(F.coalesce(col(host).cast("string"), F.lit("")).alias("host"), col(text).alias("text"))
    hosts = host_verdicts(measure_documents(bare).drop("text"), "host", {k: F.col(k) for k in MEASURES})
    key, verdict, strict, *names = fresh(docs, "host_key", "verdict", "strict", *[f"m_{k}" for k in MEASURES])
    hosts = materialize(hosts.select(F.col("host").alias(key), F.col("host_verdict").alias(verdict), F.col("strict_rules").alias(strict)), "host-verdicts")
    measured = measure_documents(docs, tuple(names), text).withColumn(key, F.coalesce(col(host).cast("string"), F.lit("")))
    m = {k: F.col(n) for k, n in zip(MEASURES, names, strict=True)}
    return join_checked(measured, hosts, [key], "left").where(_kept(m, F.col(verdict), F.col(strict))).select(*map(col, docs.columns))


#: The same rows in another form: words and lines as rows, rules as rows of one table. DuckDB.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
word AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
triple AS (SELECT *, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM word),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM triple WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
repeats AS (SELECT r, count(DISTINCT i) AS n FROM again GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS BIGINT) AS n_dup
  FROM (SELECT r, line, count(*) AS n FROM line GROUP BY r, line) GROUP BY r),
m AS (
  SELECT d.r, d.doc_id, d.host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, n_lines
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN repeats USING (r)),
near AS (
  SELECT *, n_words < {MIN_WORDS} AS short, n_repeat_words > {MAX_REPEAT_SHARE} * n_words AS repeated,
         n_symbols / greatest(n_words, 1) / {MAX_SYMBOLS} AS symbols, n_dup_lines / greatest(n_lines, 1) / {MAX_DUP_LINES} AS dup_lines,
         word_chars / greatest(n_words, 1) > {MAX_MEAN_WORD} AS long_words
  FROM m),
verdict AS (
  SELECT host, unnest(['short', 'repeated', 'symbols', 'dup_lines', 'long_words', 'any']) AS rule,
         unnest([short, repeated, symbols > 1, dup_lines > 1, long_words, short OR repeated OR symbols > 1 OR dup_lines > 1 OR long_words]) AS failed
  FROM near),
host AS (SELECT host, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM verdict GROUP BY host, rule),
mean AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS docs, count(*) AS hosts FROM host GROUP BY rule),
fit AS (
  SELECT rule, any_value(mean) AS mean, sum(n * (f / n - mean) ** 2) / any_value(docs) AS spread,
         any_value(mean * (1 - mean)) AS noise_doc, any_value(mean * (1 - mean) * hosts / docs) AS noise
  FROM host JOIN mean USING (rule) GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN noise_doc > 0 AND spread > noise THEN least({STRONGEST}, greatest({WEAKEST}, noise_doc / (spread - noise) - 1)) ELSE {STRONGEST} END AS strength FROM fit),
shrunk AS (SELECT host, rule, n, strength, (f + mean * strength) / (n + strength) AS rate FROM host JOIN prior USING (rule)),
judged AS (
  SELECT s.host, s.rate AS host_rate, concat_ws(',', {", ".join(f"CASE WHEN bool_or(t.rule = '{r}' AND t.rate > {STRICT_RATE}) THEN '{r}' END" for r in LIMITED)}) AS strict_rules,
         s.rate - 2 * sqrt(s.rate * (1 - s.rate) / (s.n + s.strength + 1)) > {BLOCK_RATE} AS blocked
  FROM shrunk s JOIN shrunk t ON t.host = s.host WHERE s.rule = 'any' GROUP BY s.host, s.rate, s.n, s.strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed,
       NOT (short OR repeated OR blocked OR long_words)
       AND symbols <= CASE WHEN contains(strict_rules, 'symbols') THEN 0.5 ELSE 1 END
       AND dup_lines <= CASE WHEN contains(strict_rules, 'dup_lines') THEN 0.5 ELSE 1 END AS kept,
       host, round(host_rate, 9) AS host_rate, strict_rules, CASE WHEN blocked THEN 'blocked' WHEN strict_rules <> '' THEN 'strict' ELSE 'open' END AS host_verdict
FROM near JOIN judged USING (host)
"""
