"""Validators of questions, choices, groups and sets: each rule is a condition with a code and a severity; findings come in one pass over the rows.

Questions carry their choices as array<struct<number:int, symbol:string, text:string, image:string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges, and the marker that stands for all choices.
SESSIONS, NUMBERS, CHOICES, ALL_CORRECT = (1, 99), (1, 500), (4, 10), -1


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def question_rules(symbols: dict[int, list[str]], image_hint: str) -> list[tuple[str, str, Column]]:
    """Q01-Q07/Q10: (code, severity, condition) over questions (text, session, number, type, model_answer, choices, correct, answer_available, has_image, image, tags, exam_name, subject_name).

    symbols: the symbols that may stand before a choice of a number. Descriptive questions need a model answer and no choices.
    """
    descriptive = F.coalesce(F.col("type") == "descriptive", F.lit(False))
    choices = F.coalesce("choices", F.expr("cast(array() as array<struct<number:int,symbol:string,text:string,image:string>>)"))
    numbers = F.transform(choices, lambda c: c["number"])
    n = F.size(choices)
    available = F.coalesce("answer_available", F.lit(True))
    image = ~_blank(F.col("image"))
    choice_image = F.exists(choices, lambda c: ~_blank(c["image"]))
    right = F.coalesce(F.col("correct") == ALL_CORRECT, F.lit(False)) | F.coalesce(F.array_contains(numbers, F.col("correct")), F.lit(False))
    table = F.create_map(*[x for k, v in symbols.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    odd_symbol = F.exists(choices, lambda c: F.coalesce(~F.array_contains(F.try_element_at(table, c["number"]), F.trim(F.coalesce(c["symbol"], F.lit("")))), F.lit(False)))
    no_space = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    tag_missing = lambda name: ~_blank(F.col("tags")) & ~_blank(F.col(name)) & ~F.contains(no_space(F.col("tags")), F.concat(F.lit("#"), no_space(F.col(name))))
    between = lambda c, r: F.coalesce(F.col(c).between(*r), F.lit(False))
    chosen = ~descriptive
    return [
        ("empty_question_text", "error", _blank(F.col("text"))),
        ("ocr_placeholder", "error", F.coalesce(F.col("text").startswith("[OCR 누락]"), F.lit(False))),
        ("invalid_session", "error", ~between("session", SESSIONS)),
        ("invalid_question_number", "error", ~between("number", NUMBERS)),
        ("missing_model_answer", "error", descriptive & _blank(F.col("model_answer"))),
        ("invalid_correct_answer", "error", chosen & available & ~right),
        ("invalid_answer_state", "error", chosen & ~available & ~F.coalesce(F.col("correct") == 0, F.lit(False))),
        ("choice_count", "error", chosen & ~(n.between(*CHOICES) & (F.sort_array(numbers) == F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))))),
        ("invalid_choice_symbol", "error", chosen & odd_symbol),
        ("empty_choice_text", "error", chosen & F.exists(choices, lambda c: _blank(c["text"]) & _blank(c["image"])) & ~image),
        ("missing_image_path", "error", F.coalesce("has_image", F.lit(False)) & ~image & ~choice_image),
        ("missing_required_image", "error", F.coalesce(F.col("text").rlike(image_hint), F.lit(False)) & ~image & ~choice_image),
        ("empty_tags", "warning", _blank(F.col("tags"))),
        ("missing_exam_tag", "warning", tag_missing("exam_name")),
        ("missing_subject_tag", "warning", tag_missing("subject_name")),
    ]


def web_rules(image_hint: str) -> list[tuple[str, str, Column]]:
    """Q13: the stricter gate of parsed exams: text, four or five choices from 1 on, an answer among them, no blank choice, images where they are named."""
    choices = F.coalesce("choices", F.expr("cast(array() as array<struct<number:int,symbol:string,text:string,image:string>>)"))
    numbers, n = F.transform(choices, lambda c: c["number"]), F.size(choices)
    right = F.coalesce(F.col("correct") == ALL_CORRECT, F.lit(False)) | F.coalesce(F.array_contains(numbers, F.col("correct")), F.lit(False))
    wants = F.coalesce("has_image", F.lit(False)) | F.coalesce(F.col("text").rlike(image_hint), F.lit(False))
    return [
        ("blank_question_text", "error", _blank(F.col("text"))),
        ("choice_count", "error", ~(n.isin(4, 5) & (F.sort_array(numbers) == F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))))),
        ("invalid_correct_answer", "error", ~right),
        ("blank_choice_text", "error", F.exists(choices, lambda c: _blank(c["text"]))),
        ("missing_question_image", "error", wants & _blank(F.col("image")) & ~F.exists(choices, lambda c: ~_blank(c["image"]))),
    ]


def group_findings(groups: DataFrame, questions: DataFrame, exam: str) -> DataFrame:
    """(exam, group, code) of groups (exam, group, first, last, children array<int>) and questions (exam, number, group, place).

    Groups meet questions by exam and number of the range, written out, so no pairs beyond a range's members are made.
    """
    named = groups.where("`group` is not null and `group` <> ''")
    codes = [groups.where("`group` is null or `group` = ''").select(exam, "group", F.lit("group_missing_id").alias("code"))]
    codes.append(named.groupBy(exam, "group").agg(F.count("*").alias("n")).where("n > 1").select(exam, "group", F.lit("duplicate_group_id").alias("code")))
    codes.append(named.where("first is null or last is null").select(exam, "group", F.lit("group_range_missing").alias("code")))
    codes.append(named.where("first > last").select(exam, "group", F.lit("group_range_order").alias("code")))
    ranged = named.where("first <= last")
    inside = ranged.select(exam, "group", F.explode(F.sequence("first", "last")).alias("number")).join(questions.select(exam, "number", F.col("group").alias("assigned")), [exam, "number"])
    held = inside.groupBy(exam, "group").agg(F.sort_array(F.collect_list("number")).alias("held"), F.bool_or(~F.col("assigned").eqNullSafe(F.col("group"))).alias("strange"))
    both = ranged.join(held, [exam, "group"], "left")
    codes.append(both.where(~F.col("children").eqNullSafe(F.coalesce("held", F.expr("cast(array() as array<int>)")))).select(exam, "group", F.lit("group_child_mismatch").alias("code")))
    codes.append(both.where("strange").select(exam, "group", F.lit("group_assignment_mismatch").alias("code")))
    member = questions.where("`group` is not null and `group` <> ''")
    codes.append(member.join(named.select(exam, "group"), [exam, "group"], "left_anti").select(exam, "group", F.lit("unknown_group_id").alias("code")))
    codes.append(member.where("place is null or place < 1").select(exam, "group", F.lit("invalid_group_order").alias("code")))
    out = codes[0]
    for c in codes[1:]:
        out = out.unionByName(c)
    return out.distinct()


def set_findings(rows: DataFrame, key: str, number: str, expected: int) -> DataFrame:
    """Per set the numbers of 1 .. expected that are missing, those that come twice, and those beyond, as comma-joined texts."""
    per = rows.groupBy(key, F.col(number).cast("int").alias("n")).agg(F.count("*").alias("c"))
    held = F.collect_set("n")
    shown = lambda a: F.array_join(F.transform(F.sort_array(a), lambda x: x.cast("string")), ",")
    full = F.sequence(F.lit(1), F.lit(expected))
    return per.groupBy(key).agg(shown(F.array_except(full, held)).alias("missing"), shown(F.collect_set(F.when(F.col("c") > 1, F.col("n")))).alias("doubles"), shown(F.array_except(held, full)).alias("unexpected"))


def master_findings(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Q19: (finding, n): repeated keys, and blank values of each required column."""
    blanks = rows.agg(*[F.count_if(_blank(F.col(c).cast("string"))).alias(c) for c in required])
    doubles = rows.groupBy(key).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")).select(F.lit("duplicate_key").alias("finding"), "n")
    return doubles.unionByName(blanks.select(F.inline(F.array(*[F.struct(F.lit(f"blank_{c}").alias("finding"), F.col(c).alias("n")) for c in required]))))


def schema_findings(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Q22: (table, what is missing) by names alone; nothing is read."""
    out = [(t, "table") for t in required if t not in tables]
    return out + [(t, c) for t, columns in required.items() if t in tables for c in columns if c not in tables[t].columns]


def staging_findings(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """Q16/Q23: (code, n) of checks whose failing rows are the given tables; a code with no rows has 0."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n") for code, df in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("code").agg(F.sum("n").alias("n"))


def gate(rows: DataFrame, codes: list[tuple[str, Column]], confidence: str, least: float = 0.70) -> DataFrame:
    """Q12: rows with their reason codes in order, distinct, low_confidence below the least, and whether they are accepted."""
    made = F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in codes], F.when(F.coalesce(F.col(confidence), F.lit(0.0)) < least, "low_confidence"))))
    return rows.withColumn("reasons", made).withColumn("accepted", F.size("reasons") == 0)


def verified_repairs(repairs: DataFrame, rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Q24: (keys, field, expected, found) of repaired values that the rows don't hold; a row that is missing or not unique is a finding "row" of its own."""
    counted = rows.withColumn("papyra_n", F.count("*").over(Window.partitionBy(*keys)))
    both = repairs.join(counted.select(*keys, "papyra_n", *[F.col(f).alias(f"papyra_{f}") for f in fields]), keys, "left")
    bad_row = F.coalesce(F.col("papyra_n"), F.lit(0)) != 1
    item = lambda field, want, got: F.struct(F.lit(field).alias("field"), want.cast("string").alias("expected"), got.cast("string").alias("found"))
    checks = [F.when(bad_row, item("row", F.lit(1), F.coalesce(F.col("papyra_n"), F.lit(0))))]
    checks += [F.when(~bad_row & F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"papyra_{f}")), item(f, F.col(f), F.col(f"papyra_{f}"))) for f in fields]
    return both.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(*keys, "x.*").distinct()
