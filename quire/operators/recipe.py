"""Reproduction recipe, reviewer scorecard, badges: text built per row by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import scores as S
from quire.functions.text import slug, strip

# Arguments in command order, spellings of "no value", marks of a status.
ARGUMENTS = (
    "learning_rate", "lr_schedule", "warmup_steps", "batch_size", "epochs", "max_steps", "optimizer",
    "weight_decay", "dropout", "grad_clip", "max_seq_length", "seed",
)
NO_VALUE = ("", "null", "None", "unknown", "not specified")
MARKS = {"specified": "[x]", "partial": "[~]", "inferred": "[?]", "missing": "[ ]"}
STATUS_LABELS = {"specified": "Specified", "partial": "Partial", "inferred": "Inferred", "missing": "Missing"}
MAX_VALUE = 80
MAX_LIBRARIES = 12
MAX_QUESTIONS = 10


def _value(c: Column) -> Column:
    return F.when(c.isNull() | c.isin(*NO_VALUE), None).otherwise(F.left(strip(c), F.lit(MAX_VALUE)))


def _quoted(c: Column) -> Column:
    """A value as it is shown on the command line: plain words bare, others in quotes."""
    esc = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    quoted = F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    return F.when(c.rlike(r"(?U)^[\w.+-]+\z"), c).otherwise(quoted)


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def synthesize_recipe(df: DataFrame) -> DataFrame:
    """Add reproduction_recipe, recipe_command and estimated_hardware.

    Text columns model_name, parameter_count_billions, framework, python_version, cuda_version,
    hardware, training_time, dataset; libraries array<string>; arguments map<string,string>; missing
    array<string>.
    """
    model = _or(_value(F.col("model_name")), "architecture_from_paper")
    dataset = _value(F.col("dataset"))
    values = {k: _value(F.try_element_at("arguments", F.lit(k))) for k in ARGUMENTS}
    # Fixed values in this function: the wording of the command and of the recipe's lines.
    lines = [F.lit("python train.py"), F.concat(F.lit('  --model_name "'), model, F.lit('"'))]
    lines += [F.concat(F.lit(f"  --{k} "), _or(_quoted(v), "<SWEEP>")) for k, v in values.items()]
    lines.append(_or(F.concat(F.lit('  --dataset "'), dataset, F.lit('"')), "  --dataset <UNSPECIFIED>"))
    command = F.concat_ws(" \\\n", *lines)

    vram = S.estimate_vram(F.col("parameter_count_billions"))
    need = lambda f: vram[f].cast("string")
    hardware = _or(_value(F.col("hardware")), "Not reported")
    summary = F.concat(
        hardware,
        _or(F.concat(F.lit(" | est. VRAM: ~"), need("inference_gb"), F.lit(" GB inference, ~"), need("training_gb"), F.lit(" GB full training")), ""),
    )
    libs = F.slice(F.filter(F.coalesce("libraries", F.array().cast("array<string>")), lambda l: F.coalesce(l, F.lit("")) != ""), 1, MAX_LIBRARIES)
    field = lambda label, c, default: F.concat(F.lit(f"- **{label}:** "), _or(c, default))
    hw = [
        F.concat(F.lit("- **Reported hardware:** "), hardware),
        field("Reported training time", _value(F.col("training_time")), "Not reported"),
        F.concat(
            F.lit("- **Estimated VRAM** ("), F.col("parameter_count_billions"), F.lit("B params): ~"), need("inference_gb"),
            F.lit(" GB for fp16 inference, ~"), need("training_gb"), F.lit(" GB for full mixed-precision Adam training (before sharding)."),
        ),
    ]
    env = [
        field("Framework", _value(F.col("framework")), "Not reported"),
        field("Python", _value(F.col("python_version")), "Not reported (3.10+ recommended)"),
        field("CUDA", _value(F.col("cuda_version")), "Not reported"),
        F.concat(F.lit("- **Libraries:** "), F.when(F.size(libs) > 0, F.array_join(libs, ", ")).otherwise("Not reported")),
    ]
    swept = F.array_compact(
        F.array(*[F.when(v.isNull(), F.lit(f"- `{k}` is not reported: sweep it or start from the framework default.")) for k, v in values.items()])
    )
    others = F.transform(
        F.filter(F.coalesce("missing", F.array().cast("array<string>")), lambda m: F.coalesce(m, F.lit("")) != ""), lambda m: F.concat(F.lit("- "), m)
    )
    warnings = F.concat(swept, others)
    warned = F.when(F.size(warnings) > 0, F.array_join(warnings, "\n")).otherwise("- None: every core argument was reported.")
    recipe = F.concat_ws(
        "\n",
        F.concat(F.lit("## Reproduction Recipe: "), model), F.lit(""),
        F.lit("### 1. Target hardware"), *hw, F.lit(""),
        F.lit("### 2. Environment blueprint"), *env, F.lit(""),
        F.lit("### 3. Execution command"), F.lit("```bash"), F.col("recipe_command"), F.lit("```"), F.lit(""),
        F.lit("### 4. Missing parameter warnings"), warned,
    )
    return df.withColumns({"recipe_command": command, "estimated_hardware": summary}).withColumn("reproduction_recipe", recipe)


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c)


def _percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def _item_line(i: Column) -> Column:
    mark = F.lit("[ ]")
    for status, shown in MARKS.items():
        mark = F.when(i["status"] == status, shown).otherwise(mark)
    value = F.when(F.coalesce(i["value"], F.lit("")) != "", F.concat(F.lit(" = `"), i["value"], F.lit("`"))).otherwise("")
    page = F.when(F.coalesce(i["citation_page"], F.lit(0)) != 0, F.concat(F.lit(" (p. "), i["citation_page"].cast("string"), F.lit(")"))).otherwise("")
    return F.concat(
        F.lit("- "), mark, F.lit(" **"), i["parameter"], F.lit("**"), value, page, F.lit(": "), i["note"],
        F.lit(" _Risk: "), i["risk_level"], F.lit("._"),
    )


def _bullets(values: Column, none: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")).otherwise(none)


def reviewer_questions(categories: Column) -> Column:
    """At most ten requests, one per missing item of high risk, in report order."""
    items = F.flatten(F.transform(categories, lambda c: c["items"]))
    open_items = F.filter(items, lambda i: (i["status"] == "missing") & (i["risk_level"] == "high"))
    return F.slice(F.transform(open_items, lambda i: F.concat(F.lit("Please report: "), i["parameter"], F.lit("."))), 1, MAX_QUESTIONS)


def scorecard(reports: DataFrame) -> DataFrame:
    """Add `markdown`: the reviewer scorecard of each report (needs a `created_at` text column)."""
    cats = F.col("categories")
    score_rows = F.transform(
        cats,
        lambda c: F.concat(
            F.lit("| "), c["category_name"], F.lit(" | "), _percent(c["weight"]), F.lit(" | "), _one_decimal(c["score"]),
            F.lit(" | "), _one_decimal(c["score"] * c["weight"]), F.lit(" |"),
        ),
    )
    sections = F.transform(
        cats,
        lambda c: F.concat(
            F.lit("\n## "), c["category_name"], F.lit(" ("), _one_decimal(c["score"]), F.lit("/100)\n\n"),
            F.array_join(F.transform(c["items"], _item_line), "\n"),
        ),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Reproducibility Scorecard: "), "title"), F.lit(""),
        F.concat(
            F.lit("**ReproScore:** "), _one_decimal(F.col("overall_score")), F.lit(" / 100 &nbsp; **Grade:** "), "grade",
            F.lit(" ("), F.coalesce("classification", S.classification_for(F.col("overall_score"))), F.lit(")"),
        ),
        F.concat(F.lit("_Generated on "), "created_at", F.lit(". Legend: [x] specified, [~] partial, [?] inferred, [ ] missing._")),
        F.lit(""), F.lit("## Score breakdown"), F.lit(""),
        F.lit("| Dimension | Weight | Score | Weighted |"), F.lit("| --- | --- | --- | --- |"),
        F.array_join(score_rows, "\n"), F.array_join(sections, "\n"),
        F.lit("\n## Missing critical parameters\n"), _bullets(F.col("missing_critical_parameters"), "- None identified."),
        F.lit("\n## Potential data-leakage risks\n"), _bullets(F.col("potential_leakage_risks"), "- None identified."),
        F.lit("\n## Reviewer questions for the authors\n"), _bullets(reviewer_questions(cats), "- No blocking questions."),
        F.lit(""), F.col("reproduction_recipe"), F.lit(""),
    )
    return reports.withColumn("markdown", text)


def scorecard_files(reports: DataFrame) -> DataFrame:
    """(file_name, markdown) of every report's scorecard."""
    name = F.concat(slug(F.col("title")), F.lit("_repro_scorecard"))
    return scorecard(reports).select(name.alias("file_name"), "markdown")


def export_scorecards(reports: DataFrame, path: str, folders: bool = False) -> None:
    """Write scorecards: as a table of file names and texts, which any number of papers allows, or as text
    files in one folder per file name, for a few."""
    files = scorecard_files(reports)
    if folders:
        files.withColumnRenamed("markdown", "value").write.mode("overwrite").partitionBy("file_name").text(path)
    else:
        files.write.mode("overwrite").parquet(path)


# Fixed values in the functions above and below: the wording of scorecards and badges.
def _host(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(F.substring_index(host, ".", 1), F.lit("link"))


def quick_badges(reports: DataFrame) -> DataFrame:
    """Short labels of a report: code, seeds, compute, leakage. One row per badge: paper_id, ord, tone, label.

    Uses categories, signals(link_checks, repo_urls, accelerators), estimated_hardware, potential_leakage_risks.
    """
    links = F.col("signals.link_checks")
    live = F.filter(links, lambda l: F.coalesce(l["live"], F.lit(False)))
    dead = F.exists(links, lambda l: F.coalesce(~l["live"], F.lit(False)))
    first_url = F.try_element_at("signals.repo_urls", F.lit(1))
    badge = lambda tone, label: F.struct((F.lit(tone) if isinstance(tone, str) else tone).alias("tone"), label.alias("label"))
    code = (
        F.when(F.size(live) > 0, badge("ok", F.concat(F.lit("Code: Verified ("), _host(F.try_element_at(live, F.lit(1))["url"]), F.lit(")"))))
        .when(dead, badge("bad", F.lit("Code: Dead link")))
        .when(first_url.isNotNull(), badge("warn", F.concat(F.lit("Code: "), _host(first_url), F.lit(" (unverified)"))))
        .otherwise(badge("bad", F.lit("Code: Missing")))
    )
    items = F.flatten(F.transform("categories", lambda c: c["items"]))
    seed = F.try_element_at(F.filter(items, lambda i: F.contains(F.lower(i["parameter"]), F.lit("seed"))), F.lit(1))
    status = None
    for key, label in STATUS_LABELS.items():
        status = (F if status is None else status).when(seed["status"] == key, label)
    shown = F.coalesce(F.when(seed["value"] != "", seed["value"]), status)
    seeds = F.when(seed.isNull() | (seed["status"] == "missing"), badge("bad", F.lit("Seeds: Missing (Risk: High)"))).otherwise(
        badge(F.when(seed["status"] == "specified", "ok").otherwise("warn"), F.concat(F.lit("Seeds: "), shown))
    )
    hardware = F.substring_index("estimated_hardware", " | ", 1)
    named = F.col("signals.accelerators")
    compute = (
        F.when((hardware != "") & (hardware != "Not reported"), badge("ok", F.concat(F.lit("Compute: "), hardware)))
        .when(F.size(named) > 0, badge("warn", F.concat(F.lit("Compute: "), F.array_join(named, ", "))))
        .otherwise(badge("bad", F.lit("Compute: Not reported")))
    )
    risks = F.size("potential_leakage_risks")
    leakage = F.when(
        risks > 0, badge("warn", F.concat(risks.cast("string"), F.lit(" leakage risk"), F.when(risks > 1, "s").otherwise("")))
    )
    rows = reports.select("paper_id", F.posexplode(F.array_compact(F.array(code, seeds, compute, leakage))).alias("ord", "b"))
    return rows.select("paper_id", (F.col("ord") + 1).cast("bigint").alias("ord"), "b.tone", "b.label")
