"""Gates before an import: reasons to reject a candidate, categories for a review, and codes of a staged bank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import payloads as P
from papyra.functions import text as X
from papyra.functions.offsets import let

LEAST_CONFIDENCE = 0.70
# What a choice must not be or hold, and what a parser may report without harm.
PLACEHOLDER = r"(?:원문\s*(?:보기\s*)?참조|보기\s*참조|이미지\s*참조|첨부\s*(?:파일|그림)\s*참조)"
CONTAMINATION = r"(?:^|\s)\d{1,3}\s*[.)]\s*(?=(?:다음|아래|[「<]))|(?:^|\s)@(?=\s|$)|해양경찰\s*채용시험|\b(?:19|20)\d{2}년\s*도.{0,40}(?:시험|경찰|해양)|^\s*(?:\([0O1-5]\)|[0O])\s+|무단\s*(?:복제|전재)|정답\s*[:：]?"
PROPOSITION = r"^[㉠-㉭](?:\s+.+)?$"
QUESTION_TEXT = r"(?:가장\s*)?(?:옳|틀)[^?？\n]{0,24}것은\s*[?？]|고려하지\s*아니한다[.)]|어느\s+[^?？\n]{0,40}(?:인가|있는가)\s*[?？9]?"
DAMAGED_MARKER, LISTED, LISTED_DASH = "^[㉦㉨㉭]", r"[㉠-㉭@]\s*[-:]", r"[㉠-㉭@]\s*-"
HARMLESS = (
    "aligned_choice_table_recovery", "coordinate_choice_recovery", "document_noise_removed", "damaged_choice_recovery", "explicit_proposition_choices", "legacy_choice_grid_recovery", "source_duplicate_choices", "source_choice_repair",
    "source_text_repair", "source_unavailable_choices", "table_choice_recovery", "underlined_choice_recovery", "validated_baseline_recovery",
)
# Categories of texts that need a look at their source, with their patterns.
REVIEWS = (
    ("pua_remaining", "[\ue000-\uf8ff]"), ("hwp_overbar_marker_review", "¯"), ("linebreak_remaining", r"[\r\t]"), ("broken_variable_note_remaining", r"단\s+는\s+[^?()]+이다\?\s*\(\s*,"), ("dangling_blank_reference", r"에서\s+에\s+(?:각각\s+)?알맞은|에서\s+에\s+각각"),
    ("quote_blank_order_suspect", r'"\s*\(\s+\)\s*\?'), ("number_unit_order_suspect", r"\b\d+\s+\d+\s*\[[^\]]+\]|\[[^\]]+\]\s+\d+\s+[가-힣]"), ("blank_unit_suspect", r"\[\s*\]\s*(?:Ω|Ω|℃|ℓ)?"), ("paren_question_order_suspect", r"\([^)]{1,60}\)\s+\?"),
)
# The text of a choice and the tag of an answer whose original is missing, and categories of quality codes.
MISSING_CHOICE, UNANSWERED_TAG = "원문 보기 참조", "answer_missing_in_source"
CATEGORY = {"ocr_noise": "ocr_noise_text", "broken_unit": "broken_unit_text", "unbalanced_delimiter": "unbalanced_paren_or_bracket", "damaged_list_marker": "damaged_list_marker"}

_NONE = "cast(array() as array<string>)"


def _when(condition: Column, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(code))).otherwise(F.expr(_NONE))


def _text_reasons(text: Column, location: str) -> Column:
    named = F.transform(X.quality_codes(text), lambda c: F.when(c == "unbalanced_delimiter", f"unbalanced_{location}_delimiter").otherwise(F.concat(c, F.lit(f"_{location}"))))
    return F.concat(_when(X.disordered(text), f"suspicious_{location}"), named)


def _format_reasons(payload: Column, location: str) -> Column:
    """Issues of a payload, then reasons of its texts."""

    def of(found):
        issues = F.transform(F.filter(found, lambda s: s["code"].isNotNull()), lambda s: F.concat(s["code"], F.lit(f"_{location}")))
        texts = F.filter(found, lambda s: ~s["code"].eqNullSafe(F.lit("invalid_format_json")))
        return F.concat(issues, F.flatten(F.transform(texts, lambda s: _text_reasons(s["text"], location))))

    return let(P.surfaces(payload, location), of)


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"[{X.SPACE}]+", ""))


def reasons(stem: Column, choices: Column, confidence: Column, diagnostics: Column, stem_format: Column | None = None, choice_formats: Column | None = None, least: float = LEAST_CONFIDENCE) -> Column:
    """Q12: why a candidate is rejected, each code once in the order of the checks; empty if it can be imported.

    choices, diagnostics: arrays of texts; choice_formats: payloads by choice. Null counts as empty; a null confidence is low.
    """
    trimmed = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), f"^[{X.SPACE}]+|[{X.SPACE}]+$", "")
    empty = F.expr(_NONE)
    parts = F.struct(trimmed(stem).alias("stem"), F.transform(F.coalesce(choices, empty), trimmed).alias("c"), F.coalesce(diagnostics, empty).alias("d"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))

    def found(x):
        c, sizes = x["c"], F.transform(x["c"], lambda t: F.length(_bare(t)))
        any_of = lambda pattern: F.exists(c, lambda t: t.rlike("(?iU)" + pattern))
        said = lambda code: F.array_contains(x["d"], code)
        labels = F.transform(c, lambda t: F.ascii(F.substring(t, 1, 1)))
        counted = F.size(c).isin(4, 5)
        promoted = counted & F.forall(c, lambda t: t.rlike("(?U)" + PROPOSITION)) & F.forall(F.transform(labels, lambda n, i: n - i), lambda n: n == ord("㉠"))
        four = F.size(c) == 4
        at = lambda k: F.get(sizes, F.lit(k))
        first3, last = F.slice(c, 1, 3), F.get(c, F.lit(3))
        most3 = F.greatest(at(0), at(1), at(2), F.lit(1))
        tail = four & (F.greatest(at(0), at(1), at(2)) <= 15) & (at(3) >= 50) & (at(3) > 3 * most3)
        mixed = (
            four & (at(0) <= 6) & (F.least(at(1), at(2)) >= 40) & (at(3) >= F.greatest(at(1), at(2)) + 40)
            | four & (F.regexp_count(last, F.lit("(?U)" + LISTED)) >= 2) & ~F.exists(first3, lambda t: t.rlike("(?U)" + LISTED))
            | four & F.forall(first3, lambda t: t.rlike("(?U)" + LISTED_DASH)) & ~last.rlike("(?U)" + LISTED_DASH)
        )
        codes = [
            _when(x["stem"] == "", "empty_stem"), _text_reasons(x["stem"], "stem"), F.flatten(F.transform(c, lambda t: _text_reasons(t, "choice"))),
            _format_reasons(stem_format, "question_format") if stem_format is not None else empty, F.flatten(F.transform(choice_formats, lambda p: _format_reasons(p, "choice_format"))) if choice_formats is not None else empty,
            _when(~counted, "invalid_choice_count"), _when(F.exists(c, lambda t: t == ""), "empty_choice"), _when(any_of(PLACEHOLDER), "placeholder_choice"),
            _when((F.size(F.array_distinct(F.transform(c, _bare))) != F.size(c)) & ~said("source_duplicate_choices"), "duplicate_choice"), _when(promoted & ~said("explicit_proposition_choices"), "proposition_choices"),
            _when(any_of(CONTAMINATION) & ~said("source_text_repair"), "contaminated_choice"), _when(F.exists(c, lambda t: t.rlike("(?U)" + QUESTION_TEXT)), "question_text_in_choice"), _when(F.exists(c, lambda t: t.rlike(DAMAGED_MARKER)), "damaged_marker_choice"),
            _when(tail, "choice_tail_contamination"), _when(mixed, "mixed_choice_layers"), _when(x["confidence"] < least, "low_confidence"), _when(F.size(F.array_except(x["d"], F.array(*[F.lit(h) for h in HARMLESS]))) > 0, "parser_diagnostic"),
        ]
        return F.array_distinct(F.concat(*[F.coalesce(k, empty) for k in codes]))

    return let(parts, found)


def review_categories(text: Column, in_table: bool | Column = False) -> Column:
    """Q17: categories of a text that should be compared with its source: those of its quality codes, then those of the patterns, then lost order. Line breaks in a table's cell are right."""
    table = in_table if isinstance(in_table, Column) else F.lit(in_table)
    names = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])

    def found(value: Column) -> Column:
        codes = F.transform(X.quality_codes(value), lambda c: names[c])
        by_pattern = [_when(value.rlike("(?U)" + p) & (~table if name == "linebreak_remaining" else F.lit(True)), name) for name, p in REVIEWS]
        return F.concat(codes, *by_pattern, _when(X.disordered(value), "suspicious_text_artifact"))

    return let(F.coalesce(text, F.lit("")), found)


def review_findings(rows: DataFrame, key: str, text: str, payload: str | None = None) -> DataFrame:
    """Q17: (key, path, category, severity) of each row's text and of its payload's texts: a payload's issues block, all else needs a look at the source."""
    plain = F.transform(review_categories(F.col(text)), lambda c: F.struct(F.lit(text).alias("path"), c.alias("category"), F.lit("needs_source_review").alias("severity")))
    found = plain
    if payload is not None:
        issue = lambda s: F.struct(s["path"].alias("path"), s["code"].alias("category"), F.lit("blocked_quality").alias("severity"))
        of = lambda s: F.transform(review_categories(s["text"], F.lit(True)), lambda c: F.struct(s["path"].alias("path"), c.alias("category"), F.lit("needs_source_review").alias("severity")))
        sound = lambda x: F.filter(x, lambda s: ~s["code"].eqNullSafe(F.lit("invalid_format_json")))
        found = F.concat(plain, let(P.surfaces(F.col(payload), payload), lambda x: F.concat(F.transform(F.filter(x, lambda s: s["code"].isNotNull()), issue), F.flatten(F.transform(sound(x), of)))))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")


def staging_codes(questions: DataFrame, choices: DataFrame, documents: DataFrame | None = None, sources: DataFrame | None = None, rejected: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Q16: one row, codes: what is wrong with a staged bank, in the order of the checks. What isn't given isn't checked.

    questions: id, set, number, text, answer, answered, source; choices: question, number, text; documents: path, role, hash, parsed, error; sources: id, path, hash, answer_path, answer_name;
    rejected: n; expected: set, n, answers_required (numbers 1 to n are expected). A null source lacks its provenance; a required answer is one of the choices, all of them (-1), or tagged as missing (questions' column tags).
    """
    # a question's choice numbers are 1 to n, as n is 4 or 5, if they set these bits
    bits = F.bit_or(F.when(F.col("number").between(1, 5), F.expr("shiftleft(1, cast(number as int))")))
    per = choices.groupBy(F.col("question").alias("id")).agg(F.count("*").alias("c"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.min("number").alias("low"), F.max("number").alias("high"), bits.alias("bits"))
    q = questions.join(per, "id", "left")
    n = F.coalesce("c", F.lit(0))
    off = (F.trim(F.coalesce("text", F.lit(""))) == "") | ~n.isin(4, 5) | (F.col("blank") > 0) | (F.col("low") != 1) | (F.col("high") != n) | F.when(n == 4, F.col("bits") != 0b11110).otherwise(F.col("bits") != 0b111110)
    # the answer of a question whose numbers are 1 to n is one of them
    off = off | ~F.col("answered").isin(0, 1) | (F.col("answered") == 0) & (F.col("answer") != 0) | (F.col("answered") == 1) & (F.col("answer") != -1) & ~F.col("answer").between(1, n)
    tags = F.coalesce(F.col("tags"), F.lit("")) if "tags" in questions.columns else F.lit("")
    tagged = F.array_contains(F.transform(F.split(tags, ","), lambda t: F.regexp_replace(F.trim(t), "^#", "")), UNANSWERED_TAG)
    fine = (F.col("answered") == 0) & (F.col("answer") == 0) & tagged | (F.col("answered") == 1) & ((F.col("answer") == -1) | F.col("answer").between(1, n))
    # all that is asked of the questions, in one pass: they meet by set, and a set's numbers one after the other
    told = q.select("set", "number", F.coalesce(off, F.lit(True)).alias("off"), F.coalesce(fine, F.lit(False)).alias("fine"), F.col("source").isNull().alias("bare")).repartition("set")
    told = told.groupBy("set", "number").agg(F.count("*").alias("n"), F.bool_or("off").alias("off"), F.bool_and("fine").alias("fine"), F.bool_or("bare").alias("bare"))
    own = [F.bool_or(F.col("n") > 1).alias("double"), F.bool_or("off").alias("off")]
    if expected is not None:
        last, asked = F.coalesce(F.greatest("n", F.lit(0)), F.lit(0)), F.col("answers_required")
        spine = expected.select("set", last.alias("last"), F.when(asked, last).otherwise(0).alias("asked"), (asked.isNull() & (last > 0)).alias("unclear"))
        spine = spine.groupBy("set").agg(F.max("last").alias("last"), F.max("asked").alias("asked"), F.bool_or("unclear").alias("unclear"), F.lit(True).alias("known"))
        told = told.join(spine, "set", "full")
        inside = lambda high: F.coalesce(F.col("number").between(1, F.col(high)), F.lit(False))
        own += [
            F.count_if(inside("last")).alias("held"), F.count_if(inside("asked") & F.col("fine")).alias("fit"), F.bool_or(F.col("known") & F.col("n").isNotNull() & ~inside("last")).alias("strange"), F.bool_or(F.col("known") & F.col("bare")).alias("bare"),
            F.max("last").alias("last"), F.max("asked").alias("asked"), F.bool_or("unclear").alias("unclear"), F.bool_or("known").alias("known"),
        ]
        per_set = told.groupBy("set").agg(*own)
        whole = per_set.agg(
            F.bool_or("double").alias("double"), F.bool_or("off").alias("off"), F.bool_or(F.col("known") & ((F.col("held") != F.col("last")) | F.col("strange") | F.col("unclear"))).alias("numbers"),
            F.bool_or(F.col("known") & (F.col("fit") != F.col("asked"))).alias("answers"), F.bool_or("bare").alias("bare"),
        )
        late = [("missing_question_numbers", "numbers"), ("missing_answers", "answers"), ("missing_provenance", "bare")]
    else:
        whole, late = told.agg(*own), []
    flags = [("placeholder_choices", choices.where(F.col("text").contains(MISSING_CHOICE)))]
    if documents is not None:
        flags.append(("unparsed_question_documents", documents.where("role = 'question' and (parsed = 0 or error is not null)")))
        if sources is not None:
            used = sources.join(questions.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
            file = lambda p: F.element_at(F.split(p, "/"), -1)
            known = documents.select(file(F.col("path")).alias("name"), "role", "hash")
            asked = known.where("role = 'question'").select("name", "hash")
            answers = known.where("role = 'answer'").select(F.col("name").alias("answer_file"))
            named = used.select("id", file(F.col("path")).alias("name"), "hash", file(F.coalesce("answer_path", F.lit(""))).alias("answer_file"), "answer_name")
            good = named.join(asked, ["name", "hash"], "left_semi").join(answers, "answer_file", "left_semi").where("answer_file = answer_name")
            flags.append(("provenance_mismatch", named.join(good.select("id"), "id", "left_anti")))
    if rejected is not None:
        flags.append(("rejected_candidates", rejected.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n > 0")))
    order = ["placeholder_choices", "duplicate_questions", "invalid_question_structure", "unparsed_question_documents", "provenance_mismatch", "rejected_candidates", *[code for code, _ in late]]
    at = lambda code: F.struct(F.lit(order.index(code)).alias("k"), F.lit(code).alias("code"))
    of_all = F.array_compact(F.array(*[F.when(F.col(c), at(code)) for code, c in [("duplicate_questions", "double"), ("invalid_question_structure", "off"), *late]]))
    seen = reduce(lambda a, b: a.unionByName(b), [df.limit(1).select(at(code).alias("f")).select("f.*") for code, df in flags], whole.select(F.explode(of_all).alias("f")).select("f.*"))
    return seen.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]).alias("codes"))
