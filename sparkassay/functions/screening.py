"""Screening predicates for question texts and generated statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkassay.functions.text import folded, is_blank, matches, strip

# Ordered patterns with our name for each; the first hit decides.
SQL_INJECTION = [
    (r"\bDROP\s+TABLE\b", "drop table"),
    (r"\bDROP\s+DATABASE\b", "drop database"),
    (r"\bTRUNCATE\b", "truncate"),
    (r"\bALTER\s+TABLE\b", "alter table"),
    (r"\bCREATE\s+TABLE\b", "create table"),
    (r"\bDELETE\s+FROM\b", "delete from"),
    (r"\bINSERT\s+INTO\b", "insert into"),
    (r"\bUPDATE\s+\w+\s+SET\b", "update set"),
    (r"--", "line comment"),
    (r"/\*", "block comment"),
    (r"\bUNION\s+(ALL\s+)?SELECT\b", "union select"),
    (r";\s*(DROP|DELETE|INSERT|UPDATE|TRUNCATE|ALTER|CREATE)", "stacked statement"),
]
PROMPT_INJECTION = [
    (r"\bignore\s+(the\s+)?(above|previous|all|prior)\b", "ignore earlier text"),
    (r"\bdisregard\s+(the\s+)?(above|previous|all|prior|your)\b", "disregard earlier text"),
    (r"\bforget\s+(the\s+)?(above|previous|all|prior|your)\b", "forget earlier text"),
    (r"\bnew\s+(task|instructions?|prompt|system\s+prompt)\b", "new instructions"),
    (r"\byou\s+are\s+now\b", "new role"),
    (r"\bact\s+as\s+(a\s+)?(?!sql|database|analyst)", "persona"),
    (r"\bpretend\s+(you\s+are|to\s+be)\b", "role play"),
    (r"\bdo\s+not\s+follow\b", "stop following"),
    (r"\byour\s+(real\s+)?(instructions?|prompt|system)\s+(are|is|say)\b", "system prompt"),
    (r"```.*system", "system block"),
]
# Unicode-aware classes and case folding, and only "\n" ends a line.
FLAGS = "(?iuUd)"


def first_hit(text: Column, lower: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first matching pattern, else null. ``lower`` is the folded text."""
    hit = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        hit = F.when(matches(text, lower, pattern, FLAGS), F.lit(name)).otherwise(hit)
    return hit


def _bound(text: Column, use) -> Column:
    """Apply ``use(text, folded)`` with both computed once per row."""
    both = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), folded(t).alias("f")))
    return F.transform(both, lambda b: use(b["t"], b["f"]))[0]


def sql_injection(text: Column) -> Column:
    return _bound(text, lambda t, f: first_hit(t, f, SQL_INJECTION))


def prompt_injection(text: Column) -> Column:
    return _bound(text, lambda t, f: first_hit(t, f, PROMPT_INJECTION))


def _verdict(category: Column, reason: Column) -> Column:
    return F.struct(category.isNull().alias("passed"), category.alias("category"), reason.alias("reason"))


def check_input(text: Column | str) -> Column:
    """``struct(passed, category, reason)``: blank, then statement patterns, then instruction overrides."""

    def judge(s: Column) -> Column:
        category = (F.when(s["blank"], F.lit("empty_input")).when(s["sql"].isNotNull(), F.lit("sql_injection"))
                    .when(s["prompt"].isNotNull(), F.lit("prompt_injection")))
        reason = F.when(s["blank"], F.lit("blank text")).otherwise(F.coalesce(s["sql"], s["prompt"]))
        return _verdict(category, reason)

    facts = _bound(strip(text), lambda t, f: F.struct(
        (t == "").alias("blank"), first_hit(t, f, SQL_INJECTION).alias("sql"),
        first_hit(t, f, PROMPT_INJECTION).alias("prompt")))
    return F.transform(F.array(facts), judge)[0]


# Tables of the four-table store a query may read by default.
ALLOWED_TABLES = ("customers", "products", "orders", "order_items")
# One lexical token, of lower-cased text. Quoted kinds come first, so that nothing inside them is a token.
TOKEN = (r"(?s)e'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|'[^']*+(?:''[^']*+)*+'|\$(\w*)\$.*?\$\1\$|"
         r'"[^"]*+(?:""[^"]*+)*+"|--[^\n]*+|/\*.*?\*/|[\p{L}_][\p{L}\p{M}\p{N}_$]*+|\p{N}[\w.]*+|\S')
SET_WORDS = ("union", "intersect", "except")
CHANGE_WORDS = ("insert", "update", "delete", "merge", "drop", "create", "alter", "truncate")
# Words that end a source list, and words after which, at the start of a bracket, a table follows.
END_WORDS = ("where", "group", "having", "order", "limit", "offset", "window", "qualify", "fetch", "values", *SET_WORDS)
TABLE_WORDS = ("table", "describe", "desc", "show", "summarize", "pivot", "unpivot")


def _lexed(sql: Column) -> Column:
    """Tokens in order as ``struct(t, k)``: text and class, without comments; literals and quoted names unquoted."""
    raw = F.filter(F.regexp_extract_all(F.lower(sql), F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("--") & ~(t.startswith("/*") & (F.length(t) > 3)))

    def classed(t):
        quoted, literal = t.startswith('"'), t.startswith("'") | t.startswith("e'") | (t.startswith("$") & (F.length(t) > 1))
        inner = F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
        kind = (F.when(t.isin("(", ")", ",", ".", ";", "select", "with", "from", "join", "lateral"), t)
                .when(t.isin("'", '"'), F.lit("loose")).when(quoted, F.lit("quoted")).when(literal, F.lit("literal"))
                .when(t.isin(*END_WORDS), F.lit("end")).when(t.isin(*CHANGE_WORDS), F.lit("change")).when(t.isin(*TABLE_WORDS), F.lit("table"))
                .when(t.rlike(r"^[\p{L}_]"), F.lit("word")).otherwise(F.lit("other")))
        return F.struct(F.when(quoted | literal, inner).otherwise(t).alias("t"), kind.alias("k"))

    return F.transform(raw, classed)


_FRAME = "struct<query:boolean,list:boolean,want:boolean,cte:boolean>"
_START = {"stack": lambda: F.array().cast(f"array<{_FRAME}>"), "query": lambda: F.lit(False), "list": lambda: F.lit(False),
          "want": lambda: F.lit(False), "cte": lambda: F.lit(False), "first": lambda: F.lit(True), "prev": lambda: F.lit(""),
          "open": lambda: F.lit(False), "tables": lambda: F.array().cast("array<string>"), "ctes": lambda: F.array().cast("array<string>"),
          "head": lambda: F.lit(None).cast("string"), "set_word": lambda: F.lit(None).cast("string"), "change": lambda: F.lit(None).cast("string"),
          "bad": lambda: F.lit(False), "done": lambda: F.array().cast("array<struct<blank:boolean,kind:string,tables:array<string>,ctes:array<string>>>")}


def _finished(s: Column) -> Column:
    kind = (F.when(s["head"].isNull(), F.lit(None).cast("string"))
            .when(s["bad"] | (F.size(s["stack"]) > 0), F.lit("nesting"))
            .when(~s["head"].isin("select", "with"), s["head"])
            .when(s["set_word"].isNotNull(), s["set_word"])
            .when(s["head"] == "with", s["change"]))
    return F.struct(s["head"].isNull().alias("blank"), kind.alias("kind"), s["tables"].alias("tables"), s["ctes"].alias("ctes"))


def _step(s: Column, x: Column) -> Column:
    """The state after one token.

    A frame is one bracket level. In it ``query`` says a SELECT was seen, ``list`` that a comma or JOIN starts another
    source, ``want`` that the next name is a source and ``cte`` that names are being defined. A bracket where a source is
    wanted is a source list of its own until a query starts in it, so a bracketed table is seen whatever else is in the bracket.
    """
    t, k = x["t"], x["k"]
    head = F.coalesce(s["head"], F.when(k.isin("word", "select", "with", "from", "join", "lateral", "end", "change", "table"), t).otherwise(F.lit("expression")))
    outer = F.size(s["stack"]) == 0

    def to(**new) -> Column:
        new = {"first": F.lit(False), "prev": t, "open": F.lit(False), "head": head} | new
        return F.struct(*[new.get(f, s[f]).alias(f) for f in _START])

    frame = F.struct(s["query"].alias("query"), s["list"].alias("list"), F.lit(False).alias("want"), s["cte"].alias("cte"))
    above = F.element_at(s["stack"], -1)
    shorter = lambda c: F.slice(s[c], F.lit(1), F.size(s[c]) - 1)
    added = lambda c: F.concat(s[c], F.array(t))
    defined = s["cte"] & s["prev"].isin("with", "recursive", ",")
    name = (F.when(s["want"], to(want=F.lit(False), open=F.lit(True), tables=added("tables")))
            .when(s["open"] & (s["prev"] == "."), to(open=F.lit(True), tables=F.concat(shorter("tables"), F.array(t))))
            .when(defined & ~((t == "recursive") & (k == "word")), to(ctes=added("ctes"), prev=F.lit("")))
            .otherwise(to()))
    starts = s["query"] | (s["first"] & ~outer) | (s["prev"] == "delete")
    return (F.when(k == "(", to(stack=F.concat(s["stack"], F.array(frame)), query=F.lit(False), list=s["want"], cte=F.lit(False),
                                first=F.lit(True), tables=F.when(s["open"], shorter("tables")).otherwise(s["tables"])))
            .when((k == ")") & outer, to(bad=F.lit(True)))
            .when(k == ")", to(stack=shorter("stack"), query=above["query"], list=above["list"], want=above["want"], cte=above["cte"]))
            .when(k == ";", F.struct(*[(F.concat(s["done"], F.array(_finished(s))) if f == "done" else v()).alias(f) for f, v in _START.items()]))
            .when(k == ",", to(want=s["list"]))
            .when(k == ".", to(open=s["open"]))
            .when(k == "select", to(query=F.lit(True), list=F.lit(False), want=F.lit(False), cte=F.lit(False)))
            .when((k == "with") & s["first"], to(cte=F.lit(True), list=F.lit(False), want=F.lit(False)))
            .when((k == "from") & starts & (s["prev"] != "distinct"), to(query=F.lit(True), list=F.lit(True), want=F.lit(True)))
            .when((k == "join") & s["list"], to(want=F.lit(True)))
            .when((k == "table") & s["first"], to(want=F.lit(True), list=F.lit(False)))
            .when((k == "end") & ~s["want"] | (k == "end") & s["first"],
                  to(list=F.lit(False), want=F.lit(False), set_word=F.coalesce(s["set_word"], F.when(outer & t.isin(*SET_WORDS), t))))
            .when((k == "change") & outer & ~s["want"] & ~defined, to(change=F.coalesce(s["change"], t)))
            .when((k == "lateral") & s["want"], to())
            .when(k == "loose", to(bad=F.lit(True)))
            .when(k.isin("other") | ((k == "literal") & ~s["want"]), to())
            .otherwise(name))


def audit_statements(sql: Column | str) -> Column:
    """One struct per ``;``-separated statement: ``blank``, ``kind`` problem, referenced ``tables``, own ``ctes``.

    One pass over the statement's tokens with a stack of brackets; the work is linear in the tokens but for the stack.
    """
    sql = F.col(sql) if isinstance(sql, str) else sql
    start = F.struct(*[v().alias(f) for f, v in _START.items()])
    return F.aggregate(_lexed(sql), start, _step, lambda s: F.concat(s["done"], F.array(_finished(s))))


def statement_kind(statements: Column) -> Column:
    """``struct(category, reason)`` of the select-only rule, nulls when every statement is a plain SELECT."""
    bad = F.filter(statements, lambda s: s["kind"].isNotNull())
    category = (F.when(statements[0]["blank"], F.lit("parse_error"))
                .when(F.size(bad) > 0, F.lit("disallowed_statement")))
    reason = F.when(category == "parse_error", F.lit("no statement")).when(category.isNotNull(), F.get(bad, 0)["kind"])
    return F.struct(category.alias("category"), reason.alias("reason"))


def table_scope(statements: Column, allowed: Column) -> Column:
    """First referenced table outside the allow-list and the statement's own CTE names, else null."""
    outside = F.flatten(F.transform(statements, lambda s: F.filter(
        s["tables"], lambda t: ~F.array_contains(allowed, t) & ~F.array_contains(s["ctes"], t))))
    return F.get(outside, 0)


def check_output(sql: Column | str, allowed: Column | None = None) -> Column:
    """``struct(passed, category, reason)``: blank, then statement kind, then table scope."""
    allowed = F.array(*[F.lit(t) for t in ALLOWED_TABLES]) if allowed is None else allowed
    sql = F.col(sql) if isinstance(sql, str) else sql

    def judge(statements: Column) -> Column:
        kind = statement_kind(statements)
        outside = table_scope(statements, allowed)
        category = F.when(is_blank(sql), F.lit("empty_output")).otherwise(F.coalesce(
            kind["category"], F.when(outside.isNotNull(), F.lit("schema_violation"))))
        reason = F.when(is_blank(sql), F.lit("blank statement")).otherwise(F.coalesce(kind["reason"], outside))
        return _verdict(category, reason)

    return F.transform(F.array(audit_statements(strip(sql))), judge)[0]


def referenced_tables(sql: Column | str) -> Column:
    """Distinct tables a statement reads, CTE names included (as a plain walk over table nodes finds them)."""
    return F.array_distinct(F.flatten(F.transform(audit_statements(sql), lambda s: s["tables"])))
