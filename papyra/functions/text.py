"""Column builders for text: canonical forms, anchors, delimiters, literal search, tags, labels, names."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions import repairs
from papyra.functions.offsets import let

# Words and word parts that turn a question's sense round.
NEGATIVE_PARTS = ("옳지않", "아닌", "틀린", "잘못된", "부적절", "하지않", "없는것", "제외한", "제외되는", "불가능")
NEGATIVE_WORDS = ("not", "incorrect", "wrong", "except", "least")
#: What every regular expression of the original counts as white space.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def canonical(text: Column) -> Column:
    """Lower case without bracketed section labels, (a) labels, choice glyphs, dashes, white space and punctuation; null counts as empty.

    Labels are looked for only where their signs occur; all single signs go in one pass.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(low.contains("과목"), F.regexp_replace(low, r"\[[^\]]*제\p{Nd}+과목[^\]]*\]", "")).otherwise(low)
    out = F.when(out.contains("("), F.regexp_replace(out, r"\(([a-z])\)", "")).otherwise(out)
    return F.regexp_replace(out, rf"[㉮㉯㉴㉵‐‑‒–—−{SPACE}.,!?？:;·ㆍ'\"“”‘’()\[\]{{}}<>/\\-]+", "")


def numbers(text: Column) -> Column:
    """All numbers, commas between digits removed, as one comma-joined text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.when(low.contains(","), F.regexp_replace(low, r"(?<=\p{Nd}),(?=\p{Nd})", "")).otherwise(low)
    return F.array_join(F.regexp_extract_all(plain, F.lit(r"\p{Nd}+(?:\.\p{Nd}+)?"), F.lit(0)), ",")


def negative(text: Column) -> Column:
    """Whether a negating word, or a negating part of the text without white space, occurs. Texts without Hangul have no such part."""
    low = F.lower(F.coalesce(text, F.lit("")))
    part = F.when(low.rlike("[가-힣]"), F.regexp_replace(low, f"[{SPACE}]+", "").rlike("|".join(NEGATIVE_PARTS))).otherwise(F.lit(False))
    return part | low.rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(NEGATIVE_WORDS) + r")(?![\p{L}\p{N}_])")


def choice_fingerprint(choices: Column) -> Column:
    """Canonical choices, empty ones dropped, sorted."""
    return F.sort_array(F.filter(F.transform(choices, canonical), lambda c: c != ""))


def spaced(text: Column) -> Column:
    """Character references of the five markup signs decoded, runs of white space (no-break spaces too) one space, trimmed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "&nbsp;|&#160;", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))


def subject_code(name: Column) -> Column:
    """auto_, a slug of at most 40 characters, and six digits of the name's SHA-1."""
    raw = F.coalesce(name, F.lit(""))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), f"[{SPACE}]+", "_"), "[^0-9a-zA-Z가-힣_]+", "")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    slug = F.when(slug == "", "subject").otherwise(F.regexp_replace(F.substring(slug, 1, 40), "_+$", ""))
    return F.concat(F.lit("auto_"), slug, F.lit("_"), F.substring(F.sha1(raw), 1, 6))


def contains_literal(text: Column, needle: str) -> Column:
    """a substring search that takes % and _ as themselves, case folded."""
    return F.instr(F.lower(F.coalesce(text, F.lit(""))), needle.lower()) > 0


def search(surfaces: list[Column], tokens: list[str]) -> Column:
    """every token is in one surface or another."""
    return reduce(lambda a, b: a & b, [reduce(lambda x, y: x | y, [contains_literal(s, t) for s in surfaces]) for t in tokens], F.lit(True))


def tagged(tags: Column, query: str) -> Column:
    """any tag of the comma- or space-separated query is one of the comma-joined tags."""
    wanted = [t for t in query.replace(",", " ").split() if t]
    have = F.transform(F.split(F.lower(tags), ","), lambda t: F.trim(t))
    return F.arrays_overlap(have, F.array(*[F.lit(t.lower()) for t in wanted])) if wanted else F.lit(True)


def clean_tag(tag: Column) -> Column:
    """A tag trimmed, with a leading #; null and blank give null."""
    out = F.trim(tag)
    return F.when(out != "", F.when(out.startswith("#"), out).otherwise(F.concat(F.lit("#"), out)))


def built_tags(metadata: list[Column], text: Column, rules: list[tuple[str, str]]) -> Column:
    """The metadata's tags, then those of the rules whose pattern matches the text in lower case; distinct, in order, joined by ", "."""
    low = F.lower(F.coalesce(text, F.lit("")))
    made = [*[clean_tag(m) for m in metadata], *[F.when(low.rlike(pattern), F.lit(tag)) for tag, pattern in rules]]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*made))), ", ")


def manual_tags(tags: Column, required: list[str]) -> Column:
    """The tags split at commas and white space, and each required one that is not there in any case of letters, joined by ", "."""
    tokens = F.filter(F.split(F.coalesce(tags, F.lit("")), rf"[,{SPACE}]+"), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "^#+", ""))
    more = F.array_compact(F.array(*[F.when(~F.array_contains(bare, r.lower().lstrip("#")), F.lit(r)) for r in required]))
    return F.array_join(F.concat(tokens, more), ", ")


def unbalanced(text: Column) -> Column:
    """Round brackets that don't pair in order, or square ones that differ in number. A closing one behind a label ("a)", "1)", "No.)") may stand alone.

    A fold over the brackets alone: depth, and whether a closing one stood without an opening one or a label.
    """
    value = F.coalesce(text, F.lit(""))
    label = r"(?:^|(?<=[^0-9A-Za-z가-힣]))(?:[A-Za-z]|[ivxIVX]{1,4}|\p{Nd}+|(?i:Ex|Example|Fig|No)\.)" + rf"[{SPACE}]*\)"
    signs = F.when(value.rlike("[()]"), F.regexp_extract_all(value, F.lit(rf"{label}|[()]"), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))

    def step(acc, s):
        close = s != "("
        depth = F.when(~close, acc["depth"] + 1).when(acc["depth"] > 0, acc["depth"] - 1).otherwise(acc["depth"])
        return F.struct(depth.alias("depth"), (acc["bad"] | (s == ")") & (acc["depth"] == 0)).alias("bad"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))
    round_ = F.aggregate(signs, zero, step, lambda a: (a["depth"] != 0) | a["bad"])
    square = F.length(F.replace(value, F.lit("["), F.lit(""))) != F.length(F.replace(value, F.lit("]"), F.lit("")))
    return round_ | square


def ladder(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule whose pattern matches."""
    out = F.lit(otherwise)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def topic_ladder(text: Column, rules: list[tuple[str, tuple]], otherwise: tuple) -> Column:
    """struct<l1, l2, l3, confidence> of the first rule whose pattern matches."""
    made = lambda t: F.struct(*[F.lit(x).alias(n) for n, x in zip(("l1", "l2", "l3", "confidence"), t)])
    out = made(otherwise)
    for pattern, topic in reversed(rules):
        out = F.when(text.rlike(pattern), made(topic)).otherwise(out)
    return out


def question_type(value: Column) -> Column:
    """Descriptive for its synonyms, else multiple_choice."""
    return F.when(F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("descriptive", "subjective", "essay", "written"), "descriptive").otherwise("multiple_choice")


# Markers of the choices 1, 2, ... by style.
MARKERS = {"legacy_korean": "㉮㉯㉴㉵⑤", "circled_number": "①②③④⑤⑥⑦⑧⑨⑩"}


def choice_marker(number: Column, style: str | None = "legacy_korean", fallback: Column | None = None) -> Column:
    """The marker of a choice's number; any other style counts as legacy_korean.

    A number without a marker is the fallback or else itself as text; what is no whole number (null, text) is the fallback or else empty.
    """
    marks = MARKERS.get(style, MARKERS["legacy_korean"])
    whole = number.try_cast("int")
    other = F.nullif(F.coalesce(fallback, F.lit("")), F.lit("")) if fallback is not None else F.lit(None).cast("string")
    mark = F.get(F.array(*[F.lit(m) for m in marks]), whole - 1)
    return F.when(whole.isNull(), F.coalesce(other, F.lit(""))).otherwise(F.coalesce(mark, other, whole.cast("string")))


def safe_stem(name: Column, most: int = 80) -> Column:
    """A path part: each sign but letters, digits, dash and underline is an underline, cut at `most`. Null gives an empty part."""
    return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_-]", "_"), 1, most)


def title_date(title: Column) -> Column:
    """struct<year, month, day, session> of a title like 2024년 3월 5일(2회); session 1 if it has none, nulls if there is no date."""
    pattern = rf"(\p{{Nd}}{{4}})년[{SPACE}]*(\p{{Nd}}{{1,2}})월[{SPACE}]*(\p{{Nd}}{{1,2}})일(?:\((\p{{Nd}}+)회\))?"
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(title, pattern, k), F.lit("")), F.lit("9999")).cast("int")
    found = title.rlike(pattern)
    return F.struct(F.when(found, part(1)).alias("year"), F.when(found, part(2)).alias("month"), F.when(found, part(3)).alias("day"), F.when(found, F.coalesce(part(4), F.lit(1))).alias("session"))


# Signs of a page's furniture in a line without blanks, and the marks of choices at which an excerpt ends.
FURNITURE, PAPER_HEAD = "합격코스|커리큘럼|동시학습|실전대비", "문제지"
EXCERPT_ENDS = (r"\(0\)", r"\(1\)", r"\(기\)", r"\(의\)", "㉦", r"㉠\s", "①", r"1\)")


def without_noise(text: Column) -> Column:
    """The text's lines in single spaces, without blank ones, advertisements, page numbers (k/n in a line under 30 signs) and short heads of papers."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    bare = lambda x: F.regexp_replace(x, f"[{SPACE}]+", "")
    said = lambda x: let(bare(x), lambda b: b.rlike(FURNITURE) | b.contains(PAPER_HEAD) & (F.length(b) < 60))
    noise = lambda x: (F.length(x) < 30) & x.contains("/") & x.rlike(r"(?U)\b\d+/\d+\b") | x.rlike("[가-힣]") & said(x)
    kept = F.array_join(F.filter(trimmed, lambda x: (x != "") & ~noise(x)), " ")
    return F.trim(F.regexp_replace(kept, f"[{SPACE}]+", " "))


def evidence(text: Column, ends: tuple[str, ...] = EXCERPT_ENDS, least: int = 40, most: int = 180) -> Column:
    """The text without noise, cut where the first match of a pattern lies behind `least` signs, `most` signs at most; an excerpt under `least` signs is the text instead."""
    def excerpt(plain: Column) -> Column:
        at = F.array_min(F.filter(F.array(*[F.regexp_instr(plain, F.lit("(?U)" + e)) - 1 for e in ends]), lambda x: x > least))
        cut = let(at, lambda a: F.when(a.isNotNull(), F.trim(F.substring(plain, F.lit(1), a))).otherwise(plain))
        return let(cut, lambda c: F.substring(F.when(F.length(c) < least, plain).otherwise(c), 1, most))

    return let(without_noise(text), excerpt)


# Words that tell hard questions and skills, topics of middle and low difficulty, and the reasons for a review.
HARD = "모두 몇|합한 값|숫자|순서대로|가장 옳지 않은 것은 모두"
MIDDLE_TOPICS, EASY_TOPICS = ("SOLAS", "MARPOL", "STCW", "UNCLOS", "COLREG", "IAMSAR"), ("일반영어·독해", "해사약어·용어")
SKILLS = (("상황|절차|입항|대화|case", "case_application"), ("모두 몇|옳지 않은 것은 모두|비교", "comparative_analysis"), ("빈칸|숫자|합한 값", "conceptual_understanding"))
REVIEW_REASONS = ("OCR/번호분할 누락으로 문항 본문 확인 필요", "주제 분류 신뢰도 낮음", "근거 발췌가 짧거나 OCR 품질 낮음")


def difficulty(text: Column, level2: Column, level1: Column, placeholder: Column, hard: str = HARD, middle=MIDDLE_TOPICS, easy=EASY_TOPICS) -> Column:
    """struct<level, risk> by the first rule that holds: placeholder, hard words (in any case), middle topics, easy topics, else medium."""
    made = lambda level, risk: F.struct(F.lit(level).alias("level"), F.lit(risk).alias("risk"))
    return F.when(placeholder, made("unknown", 0.5)).when(text.rlike("(?iU)" + hard), made("high", 1.0)).when(level2.isin(*middle), made("medium", 0.6)).when(level1.isin(*easy), made("low", 0.3)).otherwise(made("medium", 0.6))


def cognitive_skill(text: Column, placeholder: Column, skills=SKILLS) -> Column:
    """The skill of the first pattern (in any case) that a question's text matches, recall if there is none, unknown for placeholders."""
    return F.when(placeholder, "unknown").otherwise(ladder(F.coalesce(text, F.lit("")), [(f"(?iU)(?:{p})", skill) for p, skill in skills], "recall"))


def review_reasons(placeholder: Column, confidence: Column, excerpt: Column) -> Column:
    """The reasons for which a row needs review, joined by "; "; empty if it needs none."""
    reasons = F.array(F.when(placeholder, REVIEW_REASONS[0]), F.when(confidence < 0.70, REVIEW_REASONS[1]), F.when(F.length(F.coalesce(excerpt, F.lit(""))) < 40, REVIEW_REASONS[2]))
    return F.array_join(F.array_compact(reasons), "; ")


# Words that mark a file's part as one of answers or of questions.
ANSWER_PARTS, QUESTION_PARTS = ("정답", "답안", "해설", "답"), ("문제지", "문제", "자료")


def role_marker(part: Column) -> Column:
    """The word that marks a part of a file's name: an answer word anywhere in it, else a question word that it is or that a bracket follows; empty if there is none."""
    value = F.trim(F.regexp_replace(F.coalesce(part, F.lit("")), f"[{SPACE}]+", " "))
    out = F.lit("")
    for word in reversed(QUESTION_PARTS):
        out = F.when((value == word) | value.startswith(f"{word}(") | value.startswith(f"{word}["), word).otherwise(out)
    for word in reversed(ANSWER_PARTS):
        out = F.when(value.contains(word), word).otherwise(out)
    return out


def roleish(path: Column) -> Column:
    """Answerish, questionish or unknown by the marked parts of a file's name between underlines, answers first, else by a word anywhere in it."""
    stem = F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"(?<=.)\.[^.]*$", "")
    marks = F.transform(F.filter(F.split(stem, "_"), lambda p: p != ""), role_marker)
    any_of = lambda words: F.arrays_overlap(marks, F.array(*[F.lit(w) for w in words]))
    return F.when(any_of(ANSWER_PARTS), "answerish").when(any_of(QUESTION_PARTS), "questionish").when(stem.rlike("|".join(ANSWER_PARTS)), "answerish").when(stem.rlike("|".join(QUESTION_PARTS)), "questionish").otherwise("unknown")


def utc_text(at: Column) -> Column:
    """A timestamp in whole seconds as ISO text of UTC, 2026-01-02T03:04:05+00:00."""
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp_ltz"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def dated_name(name: Column, day: Column) -> Column:
    """A name followed by its day, name_2026.01.02."""
    return F.concat_ws("_", name, F.date_format(day, "yyyy.MM.dd"))


def year_or_current(year: Column, today: Column | None = None) -> Column:
    """The year, or that of today (the session's, if no other day is given) where it is null or 0."""
    return F.coalesce(F.nullif(year, F.lit(0)), F.year(F.current_date() if today is None else today))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def allowed_url(url: Column, scheme: str, host: str, blocked: list[str]) -> Column:
    """F16: scheme and host are the given ones, and no blocked part occurs."""
    same = (F.regexp_extract(url, "^([^:/?#]+)://", 1) == scheme) & (F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)) == host)
    return reduce(lambda a, b: a & ~url.contains(b), blocked, same)


def query_value(url: Column, name: str) -> Column:
    """The value of a query parameter; empty if there is none."""
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme, lower-case host and path without its last slash, of urls without query and fragment; null for others."""
    plain = url.rlike(r"^[a-z]+://[^/?#]+(?:/[^?#]*)?$")
    return F.when(plain, F.regexp_replace(F.concat(F.regexp_extract(url, "^([a-z]+://)", 1), F.lower(url_host(url)), F.regexp_extract(url, "^[a-z]+://[^/]+(/.*)?$", 1)), "/+$", ""))


def joined_base(url: Column, href: Column) -> Column:
    """The decoded last path step of a link as its page resolves it."""
    whole = F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("/"), F.concat(F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1), href)).otherwise(F.concat(F.regexp_extract(url, "^([a-z]+://[^?#]*/|[a-z]+://[^/?#]+)", 1), href))
    return F.coalesce(F.try_url_decode(F.element_at(F.split(F.regexp_replace(whole, "[?#].*$", ""), "/"), -1)), F.lit(""))


def path_year(path: Column) -> Column:
    """The first number of 1980 to 2100 that a path holds between other characters than digits."""
    return F.regexp_extract(path, r"(?:^|[^0-9])(19[89][0-9]|20[0-9]{2}|2100)(?![0-9])", 1).try_cast("int")


def nfkc(text: Column) -> Column:
    """Compatibility-composed lower case; null counts as empty. No built-in function normalises Unicode, so Arrow batches pass through Python."""
    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.fillna("").str.normalize("NFKC").str.lower()

    return normal(text)


def display_units(text: Column) -> Column:
    """Display width of the longest line: wide, full-width and ambiguous characters 2, narrow ones a half, others 1. Character widths are Python's tables."""
    @F.pandas_udf("double")
    def width(values: pd.Series) -> pd.Series:
        import unicodedata

        def units(c: str) -> float:
            return 0.5 if c in " \t.,:;!'\"|ilI" else 2.0 if unicodedata.east_asian_width(c) in "WFA" else 1.0

        return values.fillna("").map(lambda t: max((sum(map(units, line)) for line in t.splitlines()), default=0.0)).astype(float)

    return width(text)


def label(text: Column) -> Column:
    """X11: a label to compare by: lower case without white space, dashes, underlines and brackets."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[{SPACE}_()\[\]{{}}-]+", "")


def no_text_case(raw: Column, clean: Column, images: Column, questions: Column, choices: Column) -> Column:
    """Why a document gave no text, by its counts. Classes and limits are fixed values."""
    return (
        F.when(clean > 0, "has_clean_text")
        .when((raw == 0) & (images > 0), "ocr_required")
        .when(raw == 0, "empty_or_unreadable_pdf")
        .when((questions >= 1) & (choices >= 4), "text_start_detection_failed")
        .when((questions >= 5) & (choices == 0), "listing_or_non_exam_page")
        .when(raw >= 500, "text_non_exam_or_answer_only")
        .otherwise("unknown_no_text")
    )


# Patterns of document roles in names.
NOTICE = r"(?:채용|시험|연간).{0,30}공고|공고.{0,30}(?:채용|시험|계획)"
ANSWER = r"(?:기출)?(?:정답|답안)|정답\s*&\s*해설|확정\s*답안|정답\s*및\s*해설"
QUESTION = r"(?:기출)?문제(?:지)?"


#: Papers whose names say nothing of their role, and what a probe may call a role.
NAMELESS, PROBED_ANSWERS, PROBED_QUESTIONS = r"2023\s*2차\s*-\s*(?:물리|항해)$", ("정답", "답", "답안", "해설", "answer"), ("자료", "문제", "문제지", "question")


def document_role(path: Column, question_marks: Column, choice_marks: Column, answer_marks: Column, probe_text: Column | None = None, probe_role: Column | None = None) -> Column:
    """Notice, answer or question by the name, in that order, else by what a probe has read, called and counted; unknown otherwise."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")), f"[{SPACE}]+", " ")))
    file = F.element_at(F.split(path, "/"), -1)
    name, whole, stem = plain(file), plain(path), plain(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""))
    said, role = plain(probe_text if probe_text is not None else F.lit("")), plain(probe_role if probe_role is not None else F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(name.rlike(NOTICE), "notice").when(whole.rlike(ANSWER) | whole.contains("정답안"), "answer").when(name.rlike(QUESTION), "question").when(stem.rlike(NAMELESS), "question")
        .when(said.rlike(NOTICE), "notice").when(role.isin(*PROBED_ANSWERS), "answer").when(said.rlike(ANSWER) | (count(answer_marks) > 0), "answer").when(role.isin(*PROBED_QUESTIONS), "question")
        .when((count(question_marks) > 0) & (count(choice_marks) >= 4), "question").otherwise("unknown")
    )


def error_class(error: Column) -> Column:
    """The class of an error message. Words and classes are fixed values."""
    value = spaced(error)
    low = F.lower(value)
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    counted = has("mismatch", "count", "개수")
    return (
        F.when(has("correct_answer", "correct answer", "정답"), F.when(counted, "answer_key_count_mismatch").otherwise("invalid_correct_answer"))
        .when(has("answer") & has("mismatch", "count"), "answer_key_count_mismatch")
        .when(has("choice", "선택지", "보기"), "choice_count")
        .when(has("contiguous", "연속"), "question_numbers_not_contiguous")
        .when(has("ambiguous", "range"), "ambiguous_group_range")
        .when(has("image", "이미지"), "missing_question_image")
        .when(value == "", "<blank>")
        .otherwise(F.substring(F.substring_index(value, ":", 1), 1, 80))
    )


def mapped(text: Column, glyphs: dict[str, str]) -> Column:
    """Single glyphs (private-use ones, say) mapped one to one."""
    return F.translate(text, "".join(glyphs), "".join(glyphs.values()))


# Patterns of misread texts.
# (each begins with a sign beyond ASCII, 0, O, r or })
OCR_NOISE = r"다읔|디음|다음°|오으\s*것|오은\s+거\s+은|0[卜ㅏ]|(?<![A-Za-z])[O0]h(?![A-Za-z])|[卜入人]{2,}|으\s*(?:9|느|그)|으\s+거|(?<=[가-힣A-Za-z])[卜入人][가-힣A-Za-z]|[튢飇恤喬盞]|[가-힣]°[°。]?[가-힣]|(?<=[a-z])¯(?=[a-z])|\}[~=`^|\s]*[O0]\s*[가-힣ㄱ-ㅎㅏ-ㅣ]|(?<![A-Za-z])r(?=[가-힣]{2,}법\])|[己呑粼訃]"
BROKEN_UNIT = r"\[(?:0/해|Ⅵ|H기|시|외|P비|kg되|넣디|Q|\(\)|\))"
CONFUSABLE = r"\b(?:t0|0f|A11|011e|S0011)\b|\b[A-Za-z]{1,12}[01]+[A-Za-z][A-Za-z01]*\b|\b[A-Za-z][A-Za-z01]*[01]+[A-Za-z]{1,12}\b|(?<=[A-Za-z])[㈜ⅰ-ⅹ殂盞飇恤喬訃粼](?=[A-Za-z])"
CONFUSABLE_SIGN = "[01㈜ⅰ-ⅹ殂盞飇恤喬訃粼]"
DAMAGED_MARKER = r"(?m)^\s*@(?=\s*[A-Za-z가-힣])"
REPEATED_CIRCLE = r"([①-⑳])(?:\s+\1)+"
COUNTING = r"(?:모두|총)\s*몇\s*(?:개|가지|명|척)"
LIST_MARKER = r"(?<!\S)(?:[ㄱ-ㅎ][.)]|[㉠-㉻Ⓐ-Ⓩⓐ-ⓩ①-⑳]|\((?:[A-Za-z]|\d{1,2})\)|[A-Ia-i][.)](?=\s))"
CJK_NOTE = r"[（(](?=[가-힣一-龥\s,·/]{1,32}[)）])(?=[^()）]*[一-龥])[가-힣一-龥\s,·/]{1,32}[)）]"
CJK_PARTY = r"(?<![0-9A-Za-z가-힣一-龥])[甲乙丙丁](?=(?:(?:선장|경장|씨|어선|소유자|사업자|회사))?(?:에게서|에게|은|는|이|가|을|를|의|과|와|도|만)?(?:\s|[,.!?·:;)]|$))"


ROMAN = "[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]"
ROMAN_IN_LAW = rf"제{ROMAN}+-\d+장|(?:제|부속서\s*){ROMAN}+(?=(?:장(?:의)?|에서(?:의)?|에|으로|의|상))|(?<![0-9A-Za-z가-힣]){ROMAN}(?=(?:에서(?:의)?|에|으로|에게|에는|에도|은|는|이|가|을|를|의|과|와|상|하))"
ROMAN_ALONE = rf"(?<![0-9A-Za-z]){ROMAN}(?=(?:의)?(?:\s|[.,:;)\]」]|$))"
ROMAN_MIXED = r"[0-9A-Za-z가-힣*#()\\][ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅰⅱⅲⅳⅴⅵⅶⅷⅸⅹ]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅰⅱⅲⅳⅴⅵⅶⅷⅸⅹ][0-9A-Za-z가-힣*#()\\]"
HANGUL_NUMBER = r"제\d+(?=[가-힣])|\d+(?:년|개월|일|시간|분|초|회|개|명|인|척|톤|미터|해리|단계|급|종)"
MIXED_TERM = "지진파의[SP]파|A1해역|A2해역|A3해역|A4해역"
INTRUDER = r"[가-힣](?:[01IL]|[A-Za-z]{1,3})[가-힣]|[가-힣]\)(?:7b)(?=\s|[가-힣])"


def mixed_roman(text: Column) -> Column:
    """A Roman numeral inside a word, after those of laws and those that stand alone are taken out."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)" + ROMAN_IN_LAW, ""), "(?U)" + ROMAN_ALONE, "").rlike(ROMAN_MIXED)


def intruding_latin(text: Column) -> Column:
    """Latin letters or 0 and 1 inside a Hangul word, after numbers with their units and known mixed terms are taken out."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)" + HANGUL_NUMBER, ""), MIXED_TERM, "").rlike("(?U)" + INTRUDER)


def quality_codes(text: Column, words=(), phrases=()) -> Column:
    """Codes of a text that was misread: ocr_noise, broken_unit, damaged_list_marker, unbalanced_delimiter.

    Noise: signs of misreading, the caller's known misread words and phrases, digits in English words (formulas aside), Roman numerals and Latin signs
    inside words, circled numbers that repeat, and CJK signs but for notes in brackets and party names. A list is damaged if a line opens with @, or if a counting question with four colons or more and no view block has fewer than three markers.
    """
    known = repairs.known(text, words, phrases) if words or phrases else F.lit(False)
    # the text is computed once, however many checks read it
    return let(F.struct(F.coalesce(text, F.lit("")).alias("text"), known.alias("known")), lambda x: _quality_codes(x["text"], x["known"]))


def _quality_codes(value: Column, known: Column) -> Column:
    formula = value.rlike(r"^[A-Za-z0-9_+\-*/^().=\s]+$") & value.rlike(r"[()+\-*/^=]") & value.rlike(r"\d")
    # what each check needs is looked for first, as most texts lack it
    cjk = value.rlike("[一-龥]") & F.regexp_replace(F.regexp_replace(value, CJK_NOTE, ""), CJK_PARTY, "").rlike("[一-龥]")
    confusable = value.rlike(CONFUSABLE_SIGN) & ~formula & value.rlike("(?U)" + CONFUSABLE)
    roman, latin = value.rlike("[Ⅰ-Ⅹⅰ-ⅹ]") & mixed_roman(value), value.rlike("[가-힣]") & intruding_latin(value)
    noise = value.rlike(rf"(?=[0Or}}[^\x00-\x7F]])(?:{OCR_NOISE})") | confusable | value.rlike(REPEATED_CIRCLE) | cjk | roman | latin
    noise = noise | known
    colons = F.length(value) - F.length(F.replace(value, F.lit(":"), F.lit("")))
    listed = value.rlike(COUNTING) & (colons >= 4) & ~value.rlike(r"<\s*보\s*기\s*>") & (F.regexp_count(value, F.lit(LIST_MARKER)) < 3)
    return F.array_compact(F.array(F.when(noise, "ocr_noise"), F.when(value.rlike(BROKEN_UNIT), "broken_unit"), F.when(value.contains("@") & value.rlike(DAMAGED_MARKER) | listed, "damaged_list_marker"), F.when(unbalanced(value), "unbalanced_delimiter")))


# Categories named on a page's head, in the order in which they count.
CATEGORIES = (("선박관제", "선박관제 9급"), ("해경학과", "해경학과"), ("일반직", "일반직공무원"), ("국민.*(?:안전처|전처)|(?:안전처|전처).*국민", "국민안전처"), ("경장", "경장"), ("순경", "순경"), ("경찰공무원", "경찰공무원"), ("해양경찰|해영경찰|H영경찰", "해양경찰 채용"))


def page_head(text: Column, low: int = 2013, high: int = 2026) -> Column:
    """struct<year, period, session, category> of a page's first 600 to 900 characters; year null, the others a default where nothing names them.

    A year counts within low to high; its digits may be apart.
    """
    head = F.substring(spaced(text), 1, 700)
    joined = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, 600), f"[{SPACE}]+", "")
    year = F.nullif(F.regexp_extract(joined, "20[012][0-9]", 0), F.lit("")).try_cast("int")
    period = F.when(head.rlike(r"상\s*반\s*기"), "상반기").when(head.rlike(r"하\s*(?:반|만|발)\s*기"), "하반기").otherwise("")
    found = r"제\s*([1-4])\s*(회|차|자)"
    session = F.when(head.rlike(found), F.concat(F.lit("제"), F.regexp_extract(head, found, 1), F.when(F.regexp_extract(head, found, 2) == "회", "회").otherwise("차"))).otherwise("")
    return F.struct(F.when(year.between(low, high), year).alias("year"), period.alias("period"), session.alias("session"), ladder(F.substring(spaced(text), 1, 900), [(f"(?s){p}", c) for p, c in CATEGORIES], "채용구분 미상").alias("category"))


def cover(text: Column) -> Column:
    """struct<year, session, type> of a cover, by the first pattern of each that fits; null if one of them is missing."""
    dated = (r"(?s)(\d{4})\s*년\s*정기.*?제\s*회\s*(\d+)", r"(?s)(\d{4})\s*년\s*정기.*?제\s*(\d+)\s*회", r"년\s*정기\s*제\s*회\s*(\d{4})\s*(\d+)", r"년\s*제\s*회\s*정기시험\s*(\d{4})\s*(\d+)")
    pick = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(text, p, k), F.lit("")).try_cast("int") for p in dated])
    graded = F.when(text.rlike(r"(\d)급\s*([가-힣]+사)"), F.concat(F.regexp_extract(text, r"(\d)급\s*([가-힣]+사)", 1), F.lit("급"), F.regexp_extract(text, r"(\d)급\s*([가-힣]+사)", 2)))
    turned = r"급\s*([가-힣]+사)\s*(?:(?:상선|어선|국내한정|국내)\s*)?(\d)"
    other = F.when(text.rlike(turned), F.concat(F.regexp_extract(text, turned, 2), F.lit("급"), F.regexp_extract(text, turned, 1)))
    kind = F.when(text.contains("소형선박조종사"), "소형선박조종사").otherwise(F.coalesce(graded, other))
    domestic = F.when(kind.contains("항해사"), F.array_join(F.array_compact(F.array(F.when(text.contains("국내"), "국내"), F.when(text.contains("상선"), "상선").when(text.contains("어선"), "어선"))), " ")).otherwise(F.when(text.contains("국내"), "국내").otherwise(""))
    named = F.when(domestic != "", F.concat(kind, F.lit("("), domestic, F.lit(")"))).otherwise(kind)
    return F.when(pick(1).isNotNull() & pick(2).isNotNull() & kind.isNotNull(), F.struct(pick(1).alias("year"), pick(2).alias("session"), named.alias("type")))


# Signs of texts whose parts have lost their order; each begins with a sign beyond ASCII, ] or I.
ARTIFACTS = (
    r"(?:→\s*){2,}$", r"제\s+번\s+\d+\s+", r"제\s+심\s+\d+\s+", r"행정\s+사이클.+?\s+[24]\s+(?:있|하중|인장)", r"상\s+유도전동기.+?\s+3\s+회전자계", r"전압\s+증폭률이\s+배인.+?\s+100\s+나타내면", r"총톤수\s+톤.+?\s+\d+\s+", r"길이\s+미터.+?\s+\d+\s+", r"해리\s+(?:이상|이하)\s+\d+\s+", r"개의\s+\d+\s+(?:물표|마스트등|원뿔)", r"분을\s+\d+\s+넘지", r"장음\s+회와\s+단음\s+회\s+신호를\s+\d+\s+\d+", r"몇\s+\d+\s+(?:회|헥토파스칼)",
    r"시간을\s+\d+\s+초과", r"년이\s+\d+\s+경과", r"탑승한\s+\d+\s+모든", r"선원이\s+\d+\s+실행", r"^(?:약\s+)?(?:이상|이하|미만|초과)\s*\d", r"^(?:미터|센티미터)\s+(?:이상|이하|미만|초과)\s*\d", r"(?:\]\d{1,2}\.|[가-힣]\d{1,2}\.)[0-9A-Za-z가-힣\[].+\?", r"협약.+?\bSOLAS\b\s+(?:사용|옳|것은)", r"\bISM code\s+식별", r"선박용\s+수신기.+?\bGPS\s+아닌", r"경우에\d+(?:\.\d+)?서도",
)


# A number glued behind a Hangul word and followed by another; where that is right; signs around it that are read.
GLUED, GLUED_RIGHT, LAW, AROUND = r"[가-힣]{1,8}\d+(?:,\d{3})*(?:\.\d+)?\s+[가-힣]{1,8}", r"^기관[1-3]\s+문제$", r"제?\d+조(?:의\d+)?\s*제?\d+항", 12


def disordered(text: Column) -> Column:
    """Whether a sign of lost order stands in a text, or a number glued behind a Hangul word and followed by another, but for law articles within AROUND signs."""
    return let(F.trim(F.coalesce(text, F.lit(""))), _disordered)


def _disordered(value: Column) -> Column:
    marks = F.regexp_extract_all(value, F.lit("(?U)" + GLUED), F.lit(0))
    pairs = F.zip_with(marks, F.split(value, "(?U)" + GLUED, -1), lambda m, p: F.struct(m.alias("mark"), p.alias("before")))

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["mark"])
        low = F.greatest(start - AROUND, F.lit(0))
        right = x["mark"].rlike("(?U)" + GLUED_RIGHT) | F.substring(value, low + 1, end + AROUND - low).rlike("(?U)" + LAW)
        return F.struct(end.alias("at"), (acc["bad"] | ~right).alias("bad"))

    # the piece behind the last mark has no mark
    pairs = F.filter(pairs, lambda x: x["mark"].isNotNull())
    glued = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(False).alias("bad")), step, lambda a: a["bad"])
    return (value != "") & (glued | value.rlike(r"(?U)(?=[\]I[^\x00-\x7F]])(?:" + "|".join(ARTIFACTS) + ")"))
