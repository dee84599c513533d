"""Papers as ordered text lines to questions, choices, groups and answers: array functions and regular expressions over (doc, lines).

A paper is bounded: its lines meet in one row, which is cut into questions and contexts where it stands. So papers are parsed side by side, lines are shuffled
once at most, and none of them pass through Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import SPACE, spaced

# Marks of choices (open, and filled for the answer), and the words that open a paper's tail.
OPEN, FILLED = "①②③④⑤", "❶❷❸❹❺"
TAIL = ("전자문제집 CBT 홈페이지", "기출문제 및 해설집 다운로드", "전자문제집 CBT 앱")
START = r"^\s*(\p{Nd}{1,3})\s*\.(?!\p{Nd})\s*(.*)"
SUBJECT = r"^\p{Nd}+\s*과목\s*:\s*(.+)$"
RANGE = r"\[\s*(?:문제\s*)?\p{Nd}{1,3}\s*[~∼～-]\s*\p{Nd}{1,3}\s*\]|(?:문제|문항)\s*\p{Nd}{1,3}\s*[~∼～-]\s*\p{Nd}{1,3}"
PASSAGE = rf"\[공통(?:지문)?\]|다음\s*(?:글|자료|지문)[을를]?\s*(?:읽고|보고)|다음은\s*.*물음에\s*답하시오|{RANGE}"
#: A choice's mark: at a line's start or behind a space or an opening sign, and not before a colon.
MARK = rf"(?:^|(?<=[{SPACE}(\[{{:;|/\\]))[{OPEN}{FILLED}](?![:：])"
#: A line in single spaces whose first mark opens a choice: nothing stands before it, or a question mark or a colon.
OPENS = rf"^(?>.*?(?={MARK}))(?<=^ ?|[?？:：] ?)"
PICTURE = "[이미지 선지]"


def _number(mark: Column) -> Column:
    return F.greatest(F.call_function("instr", F.lit(OPEN), mark), F.call_function("instr", F.lit(FILLED), mark))


def without_running_heads(lines: DataFrame, page: str, is_margin: Column) -> DataFrame:
    """Lines without those in a margin whose text stands on two pages of the paper or more; counted over distinct pages, joined back by text."""
    heads = lines.groupBy("doc", "text").agg(F.count_distinct(page).alias("n")).where("n >= 2").select("doc", "text", F.lit(True).alias("head"))
    return lines.join(heads, ["doc", "text"], "left").where(F.col("head").isNull() | ~is_margin).drop("head")


def gathered(lines: DataFrame) -> DataFrame:
    """Papers as (doc, lines): lines is array<struct<place, text>> in the paper's order. The only shuffle that papers need."""
    return lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("lines"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.aggregate(F.array(), value, lambda kept, _: kept, use)


def _first(items: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """The place, from 1, of the first item that holds; one behind the last if there is none."""
    return _let(F.array_position(F.transform(items, holds), True), lambda k: F.when(k > 0, k.cast("int")).otherwise(F.size(items) + 1))


def _before(items: Column, place: Column) -> Column:
    return F.slice(items, F.lit(1), place - 1)


def _behind(items: Column, place: Column) -> Column:
    return F.slice(items, place, F.size(items))


def _places(items: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """The places, from 1, of the items that hold."""
    return F.filter(F.transform(items, lambda x, i: F.when(holds(x, i), i + 1)), lambda k: k.isNotNull())


def _texts(items: Column, by: str, field: str = "text") -> Column:
    return F.array_join(F.transform(items, lambda x: x[field]), by)


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _single(text: Column) -> Column:
    """As spaced, of a text that is not null; character references are looked for only where their sign is, and single spaces stay untouched."""
    return F.when(text.contains("&"), spaced(text)).otherwise(F.trim(F.regexp_replace(text, f"[{SPACE}](?:[{SPACE}]+|(?<! ))", " ")))


def _trimmed(text: Column) -> Column:
    """As spaced, of a piece of lines that are in single spaces already."""
    return F.when(text.contains("&") | text.contains("  "), spaced(text)).otherwise(F.trim(text))


def _has(text: Column, *signs: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(sign) for sign in signs])


def _line(x: Column) -> Column:
    """A line with the number of the question that it starts and what its text is: opens_tail, is_subject and context are null where no sign of theirs is."""

    def event(text: Column, number: Column) -> Column:
        is_subject = number.isNull() & text.rlike(SUBJECT)
        found = lambda y: F.struct(_has(text, *TAIL).alias("opens_tail"), y.alias("is_subject"), (y | number.isNull() & text.rlike(PASSAGE)).alias("context"))
        return F.when(_has(text, "[", "다음", "문", "과목"), _let(is_subject, found))

    def made(text: Column, number: Column, said: Column) -> Column:
        opens = text.rlike(f"[{OPEN}{FILLED}]") & said.rlike(OPENS)
        own = (x["place"].alias("place"), text.alias("text"), number.alias("number"), said.alias("said"), opens.alias("opens"))
        return _let(event(text, number), lambda y: F.struct(*own, *[y[c].alias(c) for c in ("opens_tail", "is_subject", "context")]))

    number = lambda text: _let(F.regexp_extract(text, START, 1), lambda n: F.when(n != "", _let(n.try_cast("int"), lambda k: F.when(k.between(1, 500), k))))
    said = lambda text, n: F.when(n.isNull(), text).otherwise(F.regexp_extract(text, START, 2))
    return _let(_single(F.coalesce(x["text"], F.lit(""))), lambda text: _let(number(text), lambda n: _let(said(text, n), lambda y: made(text, n, y))))


def _said(part: Column, question: Column) -> Column:
    """A context's lines as (question, kind, text, first, last, ambiguous): a subject, or a passage with the range of questions that it names."""

    def made(text: Column, head: Column) -> Column:
        bounds = F.transform(F.regexp_extract_all(F.regexp_extract(text, RANGE, 0), F.lit(r"\p{Nd}{1,3}"), F.lit(0)), lambda n: n.cast("int"))
        named = F.when(~head["is_subject"], bounds)
        subject = F.trim(F.regexp_extract(head["text"], SUBJECT, 1))
        return _let(
            named,
            lambda n: F.struct(
                question.cast("long").alias("question"),
                F.when(head["is_subject"], "subject").otherwise("passage").alias("kind"),
                F.when(head["is_subject"], subject).otherwise(text).alias("text"),
                F.array_min(n).alias("first"),
                F.array_max(n).alias("last"),
                (~head["is_subject"] & F.array_min(n).isNull()).alias("ambiguous"),
            ),
        )

    return _let(_texts(part, " "), lambda text: made(text, F.get(part, F.lit(0))))


def _blocks(body: Column, starts: Column, contexts: Column) -> Column:
    """array<struct<question, begin, till, end, contexts>>: the lines from begin to end hold a question (none for 0), those from till on the contexts behind it.

    A subject line or a passage mark ends a question only when the question has shown a choice.
    """

    def till(question: Column, begin: Column, end: Column, mine: Column) -> Column:
        shown = F.when(question == 0, 0).otherwise(begin - 1 + _first(F.slice(body, begin, end - begin), lambda x, _: x["text"].rlike(f"[{OPEN}{FILLED}]")))
        return F.when(F.size(mine) == 0, end).otherwise(_let(shown, lambda m: F.coalesce(F.get(F.filter(mine, lambda c: c > m), F.lit(0)), end)))

    def one(question: Column, begin: Column, end: Column, contexts: Column) -> Column:
        mine = F.filter(contexts, lambda c: (c >= begin) & (c < end))
        return _let(mine, lambda m: F.struct(question.alias("question"), begin.alias("begin"), till(question, begin, end, m).alias("till"), end.alias("end"), m.alias("contexts")))

    begins = F.concat(F.array(F.lit(1)), starts)
    return F.transform(begins, lambda begin, i: _let(F.coalesce(F.get(starts, i), F.size(body) + 1), lambda end: one(i, begin, end, contexts)))


def _contexts(body: Column, blocks: Column) -> Column:
    """The contexts of a paper, with their parts' numbers."""

    def of(b: Column) -> Column:
        its = F.filter(b["contexts"], lambda c: c >= b["till"])
        return _let(its, lambda at: F.transform(at, lambda c, i: _said(F.slice(body, c, F.coalesce(F.get(at, i + 1), b["end"]) - c), b["question"])))

    fields = ("question", "kind", "text", "first", "last", "ambiguous")
    found = F.flatten(F.transform(F.filter(blocks, lambda b: F.size(b["contexts"]) > 0), of))
    return F.transform(found, lambda c, i: F.struct((i + 1).cast("long").alias("part"), *[c[f].alias(f) for f in fields]))


def _asked(body: Column, b: Column) -> Column:
    """A block's question as (question, number, place, stem, rest, inner_subject): its lines without contexts up to the first that opens a choice, and from there on."""
    mixed = F.size(b["contexts"]) > 0

    def made(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        inner = F.when(mixed, F.regexp_extract(_last(F.filter(rows, lambda x: x["is_subject"]))["text"], SUBJECT, 1))
        kept = F.when(mixed, F.filter(rows, lambda x: ~F.coalesce(x["is_subject"], F.lit(False)))).otherwise(rows)
        # up to the first line whose mark opens a choice, marks are plain text
        cut = lambda its, k: F.struct(_texts(_before(its, k), " ", "said").alias("stem"), _texts(_behind(its, k), " ", "said").alias("rest"))
        fields = lambda c: F.struct(b["question"].alias("question"), head["number"].alias("number"), head["place"].alias("place"), c["stem"].alias("stem"), c["rest"].alias("rest"), inner.alias("inner_subject"))
        return _let(kept, lambda its: _let(_first(its, lambda x, _: x["opens"]), lambda k: _let(cut(its, k), fields)))

    return _let(F.slice(body, b["begin"], b["till"] - b["begin"]), made)


def _key(tail: Column, asked: Column) -> Column:
    """The answers of a tail as (numbers, marks): rows of numbers and rows of marks in turns, up to the first other line.

    asked: the paper's question numbers in order. A key counts only whole, else it is null: each turn has as many marks as numbers, no number comes twice, and all are question numbers in the paper's order.
    """

    def row(text: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\p{Nd}{1,3}"), F.lit(0)), lambda n: n.cast("int"))
        marks = F.transform(F.regexp_extract_all(text, F.lit(f"[{OPEN}{FILLED}]"), F.lit(0)), _number)
        kind = F.when(text.rlike(r"^\p{Nd}[\p{Nd}\s]*$"), "number").when(text.rlike(rf"^[{OPEN}{FILLED}][{OPEN}{FILLED}\s]*$"), "answer").otherwise("other")
        return _let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "number", numbers).when(k == "answer", marks).alias("tokens")))

    tokens = lambda turn, kind: F.flatten(F.transform(F.filter(turn, lambda r: r["kind"] == kind), lambda r: r["tokens"]))

    def turns(rows: Column) -> Column:
        starts = _places(rows, lambda r, i: (r["kind"] == "number") & ~F.coalesce(F.get(rows, i - 1)["kind"] == "number", F.lit(False)))
        cut = lambda at: F.transform(at, lambda k, i: F.slice(rows, k, F.coalesce(F.get(at, i + 1), F.size(rows) + 1) - k))
        return F.transform(_let(starts, cut), lambda t: F.struct(tokens(t, "number").alias("numbers"), tokens(t, "answer").alias("marks")))

    def whole(t: Column) -> Column:
        all_of = lambda c: F.flatten(F.transform(t, lambda x: x[c])).alias(c)
        both = F.struct(all_of("numbers"), all_of("marks"))
        even = F.forall(t, lambda x: F.size(x["numbers"]) == F.size(x["marks"]))
        once = lambda k: F.size(F.array_distinct(k["numbers"])) == F.size(k["numbers"])
        # of questions of one number the last counts; places are counted from the end
        placed = lambda k, back: _let(F.transform(k["numbers"], lambda n: F.array_position(back, n)), lambda p: F.forall(p, lambda x: x > 0) & (F.sort_array(p, asc=False) == p))
        return _let(both, lambda k: F.when(even & once(k) & _let(F.reverse(asked), lambda back: placed(k, back)), k))

    begun = _let(F.transform(tail, row), lambda rows: _behind(rows, _first(rows, lambda r, _: r["kind"] == "number")))
    found = _let(begun, lambda rows: _let(_before(rows, _first(rows, lambda r, _: r["kind"] == "other")), lambda rows: _let(turns(rows), whole)))
    return F.when(F.size(tail) > 0, found)


def _followed(asked: Column, said: Column, subjects: Column, inner: Column) -> Column:
    """array<struct<subject, group>>: for each question the subject and the group of the contexts that it follows or that name it."""

    def one(q: Column) -> Column:
        outer = _last(F.filter(subjects, lambda c: c["question"] < q["question"]))["text"]
        subject = F.coalesce(_last(F.filter(inner, lambda x: x["question"] <= q["question"]))["inner_subject"], outer)
        ranged = F.array_max(F.transform(F.filter(said, lambda c: q["number"].between(c["first"], c["last"])), lambda c: c["part"]))
        event = _last(F.filter(said, lambda c: c["question"] < q["question"]))
        group = F.coalesce(ranged, _let(event, lambda c: F.when(c["ambiguous"], c["part"])))
        return F.struct(subject.alias("subject"), group.alias("group"))

    return F.transform(asked, one)


def _placed(asked: Column, followed: Column, groups: Column, key: Column) -> Column:
    """Questions with their answer of the tail, their subject and group, and their place in the group."""

    def one(q: Column, i: Column) -> Column:
        group = F.get(groups, i)
        order = F.when(group.isNotNull(), F.size(F.filter(F.slice(groups, F.lit(1), i + 1), lambda x: x == group)))
        tail = F.when(key.isNotNull(), F.get(key["marks"], (F.array_position(key["numbers"], q["number"]) - 1).cast("int")))
        return F.struct(*[q[c].alias(c) for c in ("place", "number", "stem", "rest")], F.get(followed, i)["subject"].alias("subject"), tail.alias("tail"), group.alias("group"), order.alias("group_order"))

    return F.transform(asked, one)


def _cut(papers: DataFrame) -> DataFrame:
    """(doc, lines) as (doc, contexts, questions); a question's stem and its rest, from the first line that opens a choice, are not yet read.

    One step a select: what several columns of the next step use is computed once.
    """
    read, body, asked, said = F.col("read"), F.col("body"), F.col("asked"), F.col("contexts")
    lines = papers.select("doc", F.filter(F.transform("lines", _line), lambda x: x["text"] != "").alias("read"))
    ended = lines.select("doc", "read", _first(read, lambda x, _: x["opens_tail"]).alias("end"))
    parts = ended.select("doc", _before(read, F.col("end")).alias("body"), F.transform(_behind(read, F.col("end") + 1), lambda x: x["text"]).alias("tail"))
    marked = parts.select("*", _places(body, lambda x, _: x["number"].isNotNull()).alias("starts"), _places(body, lambda x, _: x["context"]).alias("events"))
    blocks = marked.select("doc", "body", "tail", _blocks(body, F.col("starts"), F.col("events")).alias("blocks"))
    found = blocks.select("doc", "tail", _contexts(body, F.col("blocks")).alias("contexts"), F.transform(_behind(F.col("blocks"), F.lit(2)), lambda b: _asked(body, b)).alias("asked"))
    subjects, inner = F.filter(said, lambda c: c["kind"] == "subject"), F.filter(asked, lambda q: q["inner_subject"].isNotNull())
    keyed = found.select("doc", "contexts", "asked", _key(F.col("tail"), F.transform(asked, lambda q: q["number"])).alias("key"), subjects.alias("subjects"), inner.alias("inner"))
    followed = keyed.select("doc", "contexts", "asked", "key", _followed(asked, said, F.col("subjects"), F.col("inner")).alias("followed"))
    grouped = followed.select("*", F.transform("followed", lambda r: r["group"]).alias("groups"))
    return grouped.select("doc", "contexts", _placed(asked, F.col("followed"), F.col("groups"), F.col("key")).alias("questions"))


def _marked(text: Column, shown: Callable[[Column], Column]) -> Column:
    """array<struct<number, filled, text>> of all the marks of a text, each with what follows up to the next one."""
    made = lambda item: _let(F.substring(item, 1, 1), lambda m: F.struct(_number(m).alias("number"), F.instr(F.lit(FILLED), m).cast("boolean").alias("filled"), shown(F.substring(item, 2, 2**31 - 1)).alias("text")))
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s){MARK}.*?(?={MARK}|\z)"), F.lit(0)), made)


def _firsts(rows: Column) -> Column:
    """Of each number the first."""
    firsts = lambda numbers: F.filter(rows, lambda c, i: F.array_position(numbers, c["number"]) == i + 1)
    return _let(F.transform(rows, lambda c: c["number"]), lambda numbers: F.when(F.size(F.array_distinct(numbers)) == F.size(numbers), rows).otherwise(firsts(numbers)))


def choices_of(text: Column) -> Column:
    """array<struct<number, filled, text>> of the marks of a block's text, each with what follows up to the next one; the first of each number counts."""
    return _let(_marked(text, spaced), _firsts)


def _read(questions: DataFrame) -> DataFrame:
    """Questions with the text, the choices and the answer of their stem and rest, or with the code of why they have no answer. A question is a row here."""
    prefix = F.regexp_extract("rest", rf"(?s)^(.*?)(?:{MARK}|\z)", 1)
    shown = lambda p: _let(_trimmed(p), lambda t: F.when(t == "", PICTURE).otherwise(t))
    marked = questions.select("*", _trimmed(F.concat_ws(" ", "stem", prefix)).alias("text"), _marked(F.col("rest"), shown).alias("marked"))
    marks = F.array_distinct(F.transform(F.filter("marked", lambda c: c["filled"]), lambda c: c["number"]))
    choices = F.transform(_firsts(F.col("marked")), lambda c: F.struct(c["number"].alias("number"), c["text"].alias("text")))
    read = marked.withColumn("marks", marks).withColumn("inline", F.when(F.size("marks") == 1, F.get("marks", F.lit(0))))
    coded = read.withColumn("code", F.when(F.size("marks") > 1, "multiple_inline_answers").when(F.col("inline") != F.col("tail"), "answer_mismatch"))
    answer = F.when(F.col("code").isNull(), F.coalesce("inline", "tail")).cast("int")
    return coded.select("doc", "place", "number", "subject", "text", choices.alias("choices"), answer.alias("answer"), "group", "group_order", "code")


def parsed(lines: DataFrame) -> dict[str, DataFrame]:
    """Questions, contexts and errors of papers given as (doc, place, text).

    questions: doc, place, number, subject, text, choices, answer, group (the part of its passage), group_order. Errors: two filled marks in a question, or a
    filled mark and a tail that differ; the answers of such papers are null.
    """
    return parsed_papers(gathered(lines))


def parsed_papers(papers: DataFrame) -> dict[str, DataFrame]:
    """As parsed, of papers given whole as (doc, lines): a paper is one row, so nothing is shuffled, sorted or stored."""
    made = _cut(papers)
    # an outer generator: for an inner one, Catalyst adds a filter that computes each paper a second time
    questions = _read(made.where("doc is not null").select("doc", F.inline_outer("questions")).where("number is not null"))
    contexts = made.select("doc", F.inline_outer("contexts")).where("part is not null")
    errors = questions.where("code is not null").select("doc", "number", "code")
    return {"questions": questions.drop("code"), "contexts": contexts, "errors": errors}


def segments(pages: DataFrame, document: str, page: str, text: str, start: str) -> DataFrame:
    """(document, page, number, place, segment): a page's text from each question start to the next one; places are code points from 0."""
    marks = F.regexp_extract_all(text, F.lit(start), F.lit(1))
    pieces = F.split(F.regexp_replace(text, start, "\x00$1\x01"), "\x00", -1)
    made = pages.select(document, page, F.posexplode(F.slice(pieces, F.lit(2), F.size(marks))).alias("place", "piece"))
    parts = F.split("piece", "\x01", 2)
    return made.select(document, page, F.get(parts, F.lit(0)).try_cast("int").alias("number"), F.col("place").cast("long").alias("place"), spaced(F.get(parts, F.lit(1))).alias("segment"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """OCR words (page, block, par, line, word, x, y, w, h, conf, text) as lines with their box and mean confidence; words without text or with conf below 0 go."""
    keys = ["page", "block", "par", "line"]
    good = words.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    return good.groupBy(*keys).agg(said.alias("text"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.round(F.coalesce(F.avg("conf"), F.lit(100.0)) / 100, 4).alias("confidence"))


def grid(lines_at: DataFrame, page: str, axis: str, at: str, tolerance: float) -> DataFrame:
    """The edges of a page's grid: rule lines (page, axis, at) within a tolerance of one another as their mean, numbered along each axis."""
    w = Window.partitionBy(page, axis).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > tolerance).cast("int"), F.lit(0))
    runs = lines_at.withColumn("new", new).withColumn("edge", F.sum("new").over(w))
    return runs.groupBy(page, axis, "edge").agg(F.avg(at).alias("at"), F.count("*").alias("n"))
