"""Quality rules judged by document and by host, with DataFrame functions only.

1. Each text is measured: words, characters in words, symbols, repeated lines, words in repeated five-word
   windows. Windows are first compared by hash within their text; only texts in which two hashes are equal
   sort the windows themselves, so the counts are exact.
2. Rule failures are summed by host, partial sums first: one row a host.
3. Each rule's failure rate is shrunk towards the mean of all hosts by an empirical beta prior. Its strength
   comes from moments: the spread between hosts beyond what chance gives (a moment estimator of the
   intra-class correlation). Where hosts differ no more than by chance, each has the mean rate.
4. A host fails where a shrunk rate of one of its rules is above ``max_rate``. Verdicts return to the
   documents: hosts with at least one row in ``HOT`` (so at most ``HOT`` hosts) by broadcast, all others, each
   with less than that share of the rows, by a shuffle. Texts take no part in it: measures are written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm.store import Workspace, read_table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A host is hot with one row in so many: a bound on the number of hot hosts.
HOT = 10_000
#: Documents that the prior weighs at least, however much hosts differ.
LEAST_STRENGTH = 1.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rules on the measures; each is true where a document fails. SQL and DataFrames take them alike.
RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}
BASE_RULES = ("few_words", "repeats")


def _equal_neighbours(windows: Column) -> Column:
    """Positions, ascending, of sorted (window, position) pairs whose window stands beside an equal one."""
    at = lambda j: F.get(windows, j)["window"]
    marked = F.transform(windows, lambda x, j: F.when((x["window"] == at(j - 1)) | (x["window"] == at(j + 1)), x["at"]))
    return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))


def measure(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns with the text's measures (long); null is an empty text.

    ``n_lines`` counts lines with a word, ``n_dup_lines`` those equal to an earlier one. Columns named as a
    measure are replaced.
    """
    carried = [F.col(c) for c in columns if c not in MEASURES]
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = lambda c, chars: F.translate(c, chars, "")
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: bare(x, SPACES) != "")
    words = F.filter(F.split(F.col("_text"), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    counted = docs.select(*carried, whole.alias("_text")).select(
        *carried,
        F.length(bare(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(bare(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        words.alias("_words"),
        lines.alias("_lines"),
    )
    counted = counted.select(
        *carried,
        "word_chars",
        "n_symbols",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    done = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    firsts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    parts = lambda i: [F.get("_words", i + k) for k in range(WINDOW)]
    hashed = F.when(F.col("n_words") > WINDOW, F.transform(firsts, lambda i: F.xxhash64(*parts(i))))
    counted = counted.select(*carried, *done, "_words", hashed.alias("_hashes"))
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    windows = F.sort_array(F.transform(firsts, lambda i: F.struct(F.concat_ws(" ", *parts(i)).alias("window"), i.alias("at"))))
    counted = counted.select(*carried, *done, F.when(again, windows).alias("_windows"))
    counted = counted.select(*carried, *done, _equal_neighbours(F.col("_windows")).alias("_at"))
    covered = F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return counted.select(*carried, *[repeated.alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])


def shrunk_rate(failed: Column, n: Column, all_failed: float, all_n: float, squares: float, spread: float, hosts: int) -> Column:
    """Posterior mean of a host's failure rate under a beta prior fitted to all hosts by moments.

    ``squares`` is the sum of n*n, ``spread`` that of failed*failed/n. With one host, one outcome only or no
    more spread than chance gives, the rate is that of all.
    """
    mean = all_failed / all_n if all_n else 0.0
    within = mean * (1 - mean)
    free = all_n - squares / all_n - (hosts - 1) if all_n else 0.0
    if within * free <= 0:
        return F.lit(mean)
    alike = (spread - mean * mean * all_n - within * (hosts - 1)) / (within * free)
    if alike <= 0:
        return F.lit(mean)
    strength = max(LEAST_STRENGTH, (1 - alike) / alike)
    return (failed + F.lit(strength * mean)) / (n + F.lit(strength))


def judge_hosts(measured: DataFrame, space: Workspace, host: str, max_rate: float) -> DataFrame:
    """One row a host (null is none): its documents, its shrunk rate of each rule, the highest, and whether it fails."""
    counts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    hosts = space.save(counts.agg(F.count("*").alias("n"), *[F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in RULES.items()]), "hosts")
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("n"), F.sum(n * n).alias("squares"), F.count("*").alias("hosts")]
    sums += [x for name in RULES for x in (F.sum(F.col(name).cast("double")).alias(name), F.sum(F.col(name) * F.col(name) / n).alias(f"{name}_spread"))]
    every = {k: v or 0 for k, v in hosts.agg(*sums).first().asDict().items()}
    rates = [shrunk_rate(F.col(r), n, every[r], every["n"], every["squares"], every[f"{r}_spread"], every["hosts"]).alias(f"{r}_rate") for r in RULES]
    worst = F.greatest(*[f"{r}_rate" for r in RULES])
    hot = (F.col("n") * HOT >= every["n"]).alias("hot")
    return hosts.select("host", "n", hot, *rates).withColumn("host_rate", worst).withColumn("host_failed", worst > max_rate)


def rate_documents(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``docs`` without its text: its other columns, the measures, ``base_failed``, ``host_rate``, ``host_failed`` and ``kept``.

    ``host`` names the column that says where a document comes from; null is no host, and such a document
    is judged by its own rules alone (``host_rate`` null, ``host_failed`` false). A document stays where its own
    base rules and its host pass. Rows that repeat an id are judged each; null texts are empty and fail for
    few words. Columns named as those added are replaced. An empty table stays empty.
    """
    space = Workspace(docs.sparkSession, "hosts")
    added = ("base_failed", "host_rate", "host_failed", "kept")
    columns = [c for c in docs.columns if c not in ("text", *added, *MEASURES)]
    measured = space.save(measure(docs, columns), "measures")
    verdicts = space.save(judge_hosts(measured, space, host, max_rate).select("host", "hot", "host_rate", "host_failed"), "verdicts")
    verdicts = verdicts.withColumnRenamed("host", "_host")
    hot, cold = verdicts.where("hot").drop("hot"), verdicts.where("NOT hot").drop("hot")
    of = F.col(host) == F.col("_host")
    judged = [
        measured.join(F.broadcast(hot), of).drop("_host"),
        measured.join(F.broadcast(hot.select("_host")), of, "left_anti").join(cold.hint("merge"), of).drop("_host"),
        measured.where(F.col(host).isNull()).select("*", F.lit(None).cast("double").alias("host_rate"), F.lit(False).alias("host_failed")),
    ]
    every = judged[0].unionByName(judged[1]).unionByName(judged[2])
    failed = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE_RULES))
    return every.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rate_documents(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", F.round("host_rate", 6).alias("host_rate"), "host_failed", "kept")


_RATE = """CASE WHEN m{0} * (1 - m{0}) * free <= 0 OR alike{0} <= 0 THEN m{0}
  ELSE ({0} + greatest(1, (1 - alike{0}) / alike{0}) * m{0}) / (n + greatest(1, (1 - alike{0}) / alike{0})) END"""

OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM (SELECT row, i, unnest(range(5)) AS k FROM again) GROUP BY row),
lines AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
),
measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs JOIN words USING (row) LEFT JOIN covered USING (row) LEFT JOIN lines USING (row)
),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"sum(({rule})::INT)::DOUBLE AS {name}" for name, rule in RULES.items())} FROM measured WHERE source IS NOT NULL GROUP BY source),
every AS (
  SELECT sum(n) AS all_n, count(*) AS h, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free,
    {", ".join(f"sum({r}) / sum(n) AS m{r}, sum({r} * {r} / n) AS s{r}" for r in RULES)} FROM hosts
),
prior AS (SELECT *, {", ".join(f"(s{r} - m{r} * m{r} * all_n - m{r} * (1 - m{r}) * (h - 1)) / nullif(m{r} * (1 - m{r}) * free, 0) AS alike{r}" for r in RULES)} FROM every),
verdicts AS (SELECT source, greatest({", ".join(_RATE.format(r) for r in RULES)}) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 6) AS host_rate, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM (
  SELECT *, {" OR ".join(f"({RULES[r]})" for r in BASE_RULES)} AS base_failed, coalesce(host_rate > 0.5, false) AS host_failed
  FROM measured LEFT JOIN verdicts USING (source)
)
"""
