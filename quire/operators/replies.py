"""Structured model replies: tolerant JSON, quiz items, flashcards, gaps, audit replies.

A reply stays one row until it is normalised, so none of this shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.bind import let
from quire.functions.text import strip

VARIANTS = "array<variant>"
LETTERS = "ABCD"


def json_body(reply: Column) -> Column:
    """The JSON text of a reply, without code fences or prose around it; null when there is none."""
    # The forms in which models wrap their JSON.
    bare = F.regexp_replace(strip(reply), r"(?i)\A```(?:json)?\s*|\s*```\z", "")
    valid = lambda c: F.try_parse_json(c).isNotNull()
    within = lambda b: let(F.regexp_extract(b, r"(?s)(\{.*\}|\[.*\])", 1), lambda o: F.when((o != "") & valid(o), o))
    return let(bare, lambda b: F.when(valid(b), b).otherwise(within(b)))


def parse_replies(df: DataFrame, column: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(rows with a `body` variant, rows whose reply is not JSON with an error text)."""
    tried = df.withColumn("_json", json_body(F.col(column)))
    good = tried.filter(F.col("_json").isNotNull()).withColumn("body", F.parse_json("_json")).drop("_json", column)
    bad = tried.filter(F.col("_json").isNull()).drop("_json").withColumn("error", F.lit("The model did not return valid JSON."))
    return good, bad


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _texts(v: Column, path: str) -> Column:
    listed = F.try_variant_get(v, path, VARIANTS)
    plain = F.transform(F.coalesce(listed, F.array().cast(VARIANTS)), lambda x: F.try_variant_get(x, "$", "string"))
    return F.filter(plain, lambda x: x.isNotNull())


def items_of(body: Column, name: str) -> Column:
    """The list under a name, or the reply itself when it is a list; only objects count."""
    named = F.try_variant_get(body, f"$.{name}", VARIANTS)
    items = F.coalesce(named, F.try_variant_get(body, "$", VARIANTS), F.array().cast(VARIANTS))
    return F.filter(items, lambda x: F.coalesce(_is_object(x), F.lit(False)))


def _first(values: Column, test) -> Column:
    return F.try_element_at(F.filter(values, test), F.lit(1))


def resolve_choice(answer: Column, options: Column) -> Column:
    """The option an answer means: equal, else a letter, else the first option that contains it."""
    same = _first(options, lambda o: F.lower(o) == F.lower(answer))
    letter = F.when(F.length(answer) == 1, F.instr(F.lit(LETTERS), F.upper(answer)))
    by_letter = F.when((letter > 0) & (letter <= F.size(options)), F.try_element_at(options, F.greatest(letter, F.lit(1))))
    within = _first(options, lambda o: F.contains(F.lower(o), F.lower(answer)))
    return F.coalesce(same, by_letter, within)


def _question(v: Column, quiz_type: Column) -> Column:
    """Each field is read from the variant once, and the answer is resolved once."""
    read = F.struct(
        strip(_text(v, "$.question")).alias("ask"), strip(_text(v, "$.answer")).alias("given"),
        F.transform(_texts(v, "$.options"), strip).alias("options"), _text(v, "$.explanation").alias("why"),
    )
    return let(read, lambda r: _usable(r["ask"], r["given"], r["options"], r["why"], quiz_type))


def _usable(ask: Column, given: Column, options: Column, why: Column, quiz_type: Column) -> Column:
    truth = F.when(F.startswith(F.lower(given), F.lit("t")), "True").otherwise("False")
    choice = F.when(F.size(options) >= 2, resolve_choice(given, options))
    answer = F.when(quiz_type == "true_false", truth).when(quiz_type == "mcq", choice).otherwise(given)
    shown = F.when(quiz_type == "true_false", F.array(F.lit("True"), F.lit("False"))).when(quiz_type == "mcq", options)
    item = lambda a: F.struct(ask.alias("question"), shown.alias("options"), a.alias("answer"), F.when(why != "", why).alias("explanation"))
    return F.when((ask != "") & (given != ""), let(answer, lambda a: F.when(a.isNotNull(), item(a))))


def normalize_questions(replies: DataFrame) -> DataFrame:
    """Replies(body, quiz_type, count) with `questions`: usable items, `count` at most. Empty means a failed quiz."""
    made = F.transform(items_of(F.col("body"), "questions"), lambda v: _question(v, F.col("quiz_type")))
    return replies.withColumn("questions", F.slice(F.array_compact(made), F.lit(1), F.col("count").cast("int"))).drop("body")


def normalize_cards(replies: DataFrame) -> DataFrame:
    """Replies(body, count) with `cards` that have a front and a back."""
    def card(v: Column) -> Column:
        front, back, more = _text(v, "$.front"), _text(v, "$.back"), _text(v, "$.explanation")
        item = F.struct(strip(front).alias("front"), strip(back).alias("back"), F.when(more != "", more).alias("explanation"))
        return F.when((front != "") & (back != ""), item)

    made = F.array_compact(F.transform(items_of(F.col("body"), "cards"), card))
    return replies.withColumn("cards", F.slice(made, F.lit(1), F.col("count").cast("int"))).drop("body")


def normalize_gaps(replies: DataFrame) -> DataFrame:
    """Replies(body) with `gaps`; missing fields get their defaults."""
    # The default of each field.
    defaults = {"title": "Untitled gap", "description": "", "category": "future_work", "confidence": "medium", "suggestion": ""}

    def gap(v: Column) -> Column:
        field = {k: F.coalesce(_text(v, f"$.{k}"), F.lit(d)) for k, d in defaults.items()}
        field["confidence"] = F.lower(field["confidence"])
        return F.struct(*[c.alias(k) for k, c in field.items()], _texts(v, "$.papers").alias("papers"))

    return replies.withColumn("gaps", F.transform(items_of(F.col("body"), "gaps"), gap)).drop("body")


def audit_parts(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Audit replies(paper_id, body) to (items, rubric scores, lists and recipe) as `build_report` takes them."""
    from quire.operators.audit import DIMENSIONS, ITEM
    from quire.operators.recipe import ARGUMENTS

    body = F.col("body")
    dims = F.array(*[F.struct(F.lit(k).alias("dim_key"), F.try_variant_get(body, f"$.dimensions.{k}", "variant").alias("v")) for k, *_ in DIMENSIONS])
    by_dim = replies.select("paper_id", F.explode(dims).alias("d")).select("paper_id", "d.dim_key", "d.v")
    objects = by_dim.filter(F.coalesce(_is_object(F.col("v")), F.lit(False)))
    items = objects.select(
        "paper_id", "dim_key", F.posexplode(F.filter(F.try_variant_get("v", "$.items", VARIANTS), _is_object)).alias("ord", "i")
    ).select("paper_id", "dim_key", F.col("ord").cast("bigint").alias("ord"), *[_text(F.col("i"), f"$.{c}").alias(c) for c in ITEM])
    rubrics = objects.select("paper_id", "dim_key", _text(F.col("v"), "$.score").alias("score"))
    plain = ("model_name", "parameter_count_billions", "framework", "python_version", "cuda_version", "hardware", "training_time", "dataset")
    rest = replies.select(
        "paper_id",
        _texts(body, "$.missing_critical_parameters").alias("missing"),
        _texts(body, "$.potential_leakage_risks").alias("leakage"),
        *[_text(body, f"$.recipe.{c}").alias(c) for c in plain],
        _texts(body, "$.recipe.libraries").alias("libraries"),
        F.create_map(*[x for a in ARGUMENTS for x in (F.lit(a), _text(body, f"$.recipe.arguments.{a}"))]).alias("arguments"),
    )
    return items, rubrics, rest


def grade_quiz(answers: DataFrame, key: DataFrame) -> DataFrame:
    """answers(session_id, quiz_id, item_no, answer) against key(quiz_id, item_no, answer)."""
    norm = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    right = key.select("quiz_id", "item_no", norm(F.col("answer")).alias("_right"))
    joined = right.join(answers.withColumn("_given", norm(F.col("answer"))), ["quiz_id", "item_no"])
    return joined.groupBy("session_id", "quiz_id").agg(
        F.count_if(F.col("_given") == F.col("_right")).alias("score"), F.count("*").alias("n_items")
    )
