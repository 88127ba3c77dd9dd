"""Evidence that needs no model: pattern counts, repository links, accelerators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scores import link_state

# Signal patterns (JVM dialect, Unicode-aware), hosts of repositories, limits. A pattern begins with a look
# at the characters that a match can begin with, which passes over most places without the dearer look for a word's edge.
FLAGS = "(?iuU)"
SIGNALS = {
    "seed": r"(?=[rs])\b(random\s+)?seeds?\b",
    "accelerator": r"(?=[ahvlprtg])\b(A100|H100|V100|A6000|A40|L40S?|P100|T4|RTX\s?\d{4}|TPU\s?v?\d|GPUs?)\b",
    "gpu_hours": r"(?=[gtwhd])\b(GPU[- ]hours?|TPU[- ]hours?|wall[- ]clock|hours on|days on)\b",
    "variance": r"(?=[±\\sec9])(±|\\pm|standard deviation|std\.?|error bars?|confidence interval|\b95%\s*CI\b)",
    "multiple_runs": r"(?=[am\d])(\b(averaged over|average of|mean of|across)\s+\d+\s+(runs|seeds|trials)\b|\b\d+\s+(random\s+)?(seeds|runs|trials)\b)",
    "significance": r"(?=[ptwbs])(p\s*[<≤=]\s*0?\.\d+|p\s*\$?\\le\s*\$?\s*0?\.\d+|t-test|wilcoxon|permutation test|bootstrap|significan(t|ce))",
    "code_promise": r"(?=[cmd])\b(code|models?|data)\s+(will be|would be|is to be)\s+(made\s+)?(publicly\s+)?(available|released|open[- ]sourced)\b",
    "code_available": r"(?=[cimw])\b(code|implementation|models?|checkpoints?|weights)\s+(is|are)\s+(publicly\s+)?(available|released)\b",
    "environment": r"(?=[repdctj])\b(requirements\.txt|environment\.ya?ml|pyproject\.toml|dockerfile|docker image|conda env|CUDA\s?\d+(\.\d+)?|PyTorch\s?\d|TensorFlow\s?\d|JAX)\b",
    "contamination": r"(?=[cdonl])\b(contaminat\w*|de-?dup\w*|overlap (between|with)|n-gram overlap|leak\w*)\b",
    "carbon": r"(?=[cke])\b(CO2\b|CO₂(?!\w)|(carbon|kWh|energy consumption|emissions)\b)",
}
URL = r"(?i)https?://[^\s)\]}>,;\"']+"
REPO_HOSTS = ("github.com", "gitlab.com", "huggingface.co", "bitbucket.org", "zenodo.org", "codeocean.com", "osf.io")
GENERIC_ACCELERATORS = ("GPU", "GPUS")
MAX_URLS = 8
MAX_ACCELERATORS = 6
MAX_LINK_CHECKS = 3



def joined_texts(texts: DataFrame) -> DataFrame:
    """One row per paper: its texts(paper_id, seq, text) in order, joined by line breaks.

    Patterns may run over any number of white-space characters and so over any border, so they are
    matched on the whole text. Admission bounds a paper's size, and so the size of such a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return texts.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))


def _counts(patterns: Mapping[str, str]) -> list[Column]:
    return [F.regexp_count("text", F.lit(FLAGS + p)).cast("bigint").alias(n) for n, p in patterns.items()]


def signal_counts(texts: DataFrame, patterns: Mapping[str, str] = SIGNALS) -> DataFrame:
    """Number of matches of each pattern in a paper's texts joined by line breaks, one column each."""
    return joined_texts(texts).select("paper_id", *_counts(patterns))


def urls_in(text: Column, hosts: Sequence[str] = REPO_HOSTS) -> Column:
    """Repository addresses of one text: the host name anywhere in the address counts."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), 0), lambda u: F.rtrim(u, F.lit(".")))
    named = lambda u: F.lower(u).rlike("|".join(h.replace(".", r"\.") for h in hosts))
    return F.filter(found, named)


def _first_urls(hosts: Sequence[str], limit: int) -> Column:
    return F.slice(F.array_distinct(urls_in(F.col("text"), hosts)), 1, limit)


def _first_names(pattern: str, generic: Sequence[str], limit: int) -> Column:
    names = F.transform(F.regexp_extract_all("text", F.lit(FLAGS + pattern), 0), lambda m: F.replace(F.upper(m), F.lit(" "), F.lit("")))
    return F.slice(F.array_sort(F.array_except(names, F.array(*map(F.lit, generic)))), 1, limit)


def _numbered(df: DataFrame, values: Column, name: str) -> DataFrame:
    rows = df.select("paper_id", F.posexplode(values).alias("_at", name))
    return rows.select("paper_id", (F.col("_at") + 1).cast("bigint").alias("ord"), name)


def repo_urls(texts: DataFrame, hosts: Sequence[str] = REPO_HOSTS, limit: int = MAX_URLS) -> DataFrame:
    """First distinct repository addresses of each paper, in the order they are met."""
    return _numbered(joined_texts(texts), _first_urls(hosts, limit), "url")


def accelerators(
    texts: DataFrame, pattern: str = SIGNALS["accelerator"], generic: Sequence[str] = GENERIC_ACCELERATORS, limit: int = MAX_ACCELERATORS
) -> DataFrame:
    """First distinct accelerator names of each paper in alphabetical order."""
    return _numbered(joined_texts(texts), _first_names(pattern, generic, limit), "name")


def as_texts(chunks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Chunks in order, then table Markdown, as numbered texts of a paper.

    Overlapping chunks repeat text, and repeated text counts again. Tables are numbered apart, far
    behind the chunks: Markdown rows start with a bar, so no match runs from one into the next.
    """
    rows = chunks.select("paper_id", F.col("chunk_index").cast("bigint").alias("seq"), "text")
    if tables is None:
        return rows
    behind = F.lit(1 << 40) + F.col("table_index").cast("bigint")
    return rows.unionByName(tables.select("paper_id", behind.alias("seq"), F.col("markdown").alias("text")))


def scan_signals(texts: DataFrame, patterns: Mapping[str, str] = SIGNALS) -> DataFrame:
    """Counts, repository addresses and accelerator names, one row per paper, from one pass over the texts."""
    return joined_texts(texts).select(
        "paper_id",
        *_counts(patterns),
        _first_urls(REPO_HOSTS, MAX_URLS).alias("repo_urls"),
        _first_names(SIGNALS["accelerator"], GENERIC_ACCELERATORS, MAX_ACCELERATORS).alias("accelerator_names"),
    )


def link_checks(urls: DataFrame, statuses: DataFrame, limit: int = MAX_LINK_CHECKS) -> DataFrame:
    """State of a paper's first links from a table (url, status); links without a status are unverified.

    urls(paper_id, ord, url) as given by `repo_urls`.
    """
    first = urls.filter(F.col("ord") <= limit)
    known = statuses.groupBy("url").agg(F.max("status").alias("_code"))
    return first.join(known, "url", "left").select(
        "paper_id", "ord", "url",
        link_state(F.col("_code")).alias("live"),
        F.coalesce(F.col("_code").cast("string"), F.lit("not checked")).alias("status"),
    )


def signals_summary(signals: DataFrame, links: DataFrame | None = None, names: Sequence[str] = tuple(SIGNALS)) -> DataFrame:
    """The signals as lines of text. links(paper_id, ord, url, live, status)"""
    counts = [F.concat(F.lit(f"- {n}: "), F.col(n).cast("string"), F.lit(" mention(s)")) for n in names]
    listed = lambda c, none: F.coalesce(F.when(F.size(c) > 0, F.array_join(c, ", ")), F.lit(none))
    lines = [
        *counts,
        F.concat(F.lit("- accelerators named: "), listed("accelerator_names", "none")),
        F.concat(F.lit("- repository URLs: "), listed("repo_urls", "none found")),
    ]
    if links is None:
        return signals.withColumn("signals_text", F.concat_ws("\n", *lines))
    state = F.when(F.col("live"), "live").when(F.col("live").isNull(), "unverified").otherwise("DEAD (not found)")
    line = F.concat(F.lit("- link check "), "url", F.lit(": "), state, F.lit(" ("), F.col("status"), F.lit(")"))
    per_paper = links.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("_l"))
    tail = F.transform("_l", lambda l: l["line"])
    return signals.join(per_paper, "paper_id", "left").withColumn("signals_text", F.concat_ws("\n", *lines, tail)).drop("_l")
