"""Selectors as regular expressions over root-to-node trails.

A path of child and descendant steps with tag and class tests decides about a node by its
way from the root alone, and the set of such ways is a regular language. Compiling a
selector to a pattern over `trail` therefore turns evaluation into a filter: no join per
step, no tree walk, nothing shuffled. Compilation itself is a Column expression, so a
selector table of any size is compiled where it lies.

Accepted: `/` and `//` steps with a tag or `*`; predicates contains(@a,'v'),
starts-with(@a,'v'), @a='v', @a, text()='v', joined by `and` (attributes other than class,
and text(), on the last step only); a last `/@a` or `/text()`, also after `//`; string(...)
round the whole. A text() test holds for an element with a child text node equal to 'v'
(raw text, as XPath compares it); it is a semi-join on (page, parent, text) of text rows.
Other XPath goes through ``eval_selector_literal``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmark.functions.text import strip
from leafmark.operators.tree import text_content
from leafmark.session import stage

_VALUE = r"(?:'[^']*'|\"[^\"]*\")"
_COND = (
    r"(?:(?:contains|starts-with)\(\s*@[\w:\-]+\s*,\s*" + _VALUE + r"\s*\)"
    r"|@[\w:\-]+\s*=\s*" + _VALUE + r"|text\(\)\s*=\s*" + _VALUE + r"|@[\w:\-]+)"
)
_PRED = r"\[\s*" + _COND + r"(?:\s+and\s+" + _COND + r")*\s*\]"
_STEP = r"//?(?:\*|[A-Za-z_][\w.\-]*)(?:" + _PRED + r")*"
_LAST = r"//?(?:@[\w:\-]+|text\(\))"
_PATH = r"(?:(?:" + _STEP + r")+(?:" + _LAST + r")?|/" + _LAST + r")"
_COND_PARTS = (
    r"(contains|starts-with)?\(?\s*@([\w:\-]+)\s*(?:[,=]\s*(?:'([^']*)'|\"([^\"]*)\"))?"
)

# How the problem of a selector begins that is valid but not in the accepted forms.
UNSUPPORTED = "Unsupported form: "

# Any number of steps of a trail, as one loop over characters: a loop over steps would need
# stack in proportion to a page's depth.
_ANY_STEPS = "(?:/(?s:.*))?"

COMPILED = ["pattern", "leaf", "terminal", "whole", "conds", "problem"]


def _conditions(step: Column) -> Column:
    """Tests of one step as (op, attr, value) structs."""
    found = F.regexp_extract_all(step, F.lit(_COND), F.lit(0))

    def part(cond: Column, i: int) -> Column:
        return F.regexp_extract(cond, _COND_PARTS, i)

    said = r"=\s*(?:'([^']*)'|\"([^\"]*)\")"
    return F.transform(found, lambda c: F.when(c.startswith("text()"), F.struct(
        F.lit("text").alias("op"), F.lit("text()").alias("attr"),
        F.concat(F.regexp_extract(c, said, 1), F.regexp_extract(c, said, 2)).alias("value"),
    )).otherwise(F.struct(
        F.when(part(c, 1) != "", part(c, 1)).when(c.rlike("[=]"), "equals").otherwise("present").alias("op"),
        part(c, 2).alias("attr"),
        F.concat(part(c, 3), part(c, 4)).alias("value"),
    )))


def _quoted(col: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(col, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _class_test(cond: Column) -> Column:
    value = _quoted(F.replace(cond["value"], F.lit("/"), F.lit("\x01")))
    return (
        F.when(cond["op"] == "contains", F.concat(F.lit("(?=[^/]*"), value, F.lit(")")))
        .when(cond["op"] == "starts-with", F.concat(F.lit("(?="), value, F.lit(")")))
        .when(cond["op"] == "equals", F.concat(F.lit("(?="), value, F.lit("(?:/|\\z))")))
        .otherwise("(?=[^/])")
    )


def _step_pattern(step: Column, i: Column) -> Column:
    tag = F.regexp_extract(step, r"^//?([^\[]+)", 1)
    class_tests = F.filter(_conditions(step), lambda c: c["attr"] == "class")
    # A first `//` may start at any step of the trail, so that pattern is left unanchored.
    lead = F.when(step.startswith("//"), F.when(i == 0, "").otherwise(_ANY_STEPS)).otherwise(
        F.when(i == 0, "^").otherwise("")
    )
    return F.concat(
        lead,
        F.lit("/"),
        F.when(tag == "*", "[^/|]*").otherwise(F.replace(tag, F.lit("."), F.lit("\\."))),
        F.lit("\\|"),
        F.array_join(F.transform(class_tests, _class_test), ""),
        F.lit("[^/]*"),
    )


def compile_selectors(df: DataFrame) -> DataFrame:
    """Add the COMPILED columns to rows with an `xpath`; `problem` is null when it can be
    evaluated.

    `pattern` is found in the trail of selected elements, `leaf` is their tag, `terminal`
    what is read from them ("", "text()" or "@name"), `whole` marks string(...), and
    `conds` tests attributes of the element itself. Pages of one make share selectors, so
    each distinct one is compiled once, written (a plan that reads the result several times
    would carry the long expressions as often, and the driver with it) and joined back:
    broadcast if few, else by a join whose one row per selector lets the adaptive skew join
    split a common one.
    """
    compiled = stage(_compile(df.select("xpath").filter(F.col("xpath").isNotNull()).distinct()), "compiled")
    return df.join(compiled, "xpath", "left").withColumn(
        "problem", F.when(F.col("xpath").isNull(), "Invalid expression").otherwise(F.col("problem"))
    ).select(*df.columns, *COMPILED)


_AXES = (
    "ancestor|ancestor-or-self|attribute|child|descendant|descendant-or-self|following|following-sibling"
    "|parent|preceding|preceding-sibling|self"
)
_NODE_TEST = r"(?:\*|text\(\)|node\(\)|comment\(\)|[A-Za-z_][\w.\-]*)"
_LOOSE_STEP = rf"(?:\.\.?|(?:@|(?:{_AXES})::)?{_NODE_TEST})(?:\[\])*"
_LOOSE_PATH = rf"\(*(?://?)?{_LOOSE_STEP}\)*(?:\[\])*(?://?{_LOOSE_STEP}\)*(?:\[\])*)*"


def _well_formed(text: Column) -> Column:
    """Does it read like a path of the full language: known axes and node tests, quotes closed,
    and every predicate closed and not empty? Predicates are folded from the inside out."""
    bare = F.regexp_replace(text, _VALUE, "0")
    closed = ~bare.rlike("['\"]") & ~bare.rlike(r"\[\s*\]")
    for _ in range(4):
        bare = F.regexp_replace(bare, r"\[[^\[\]]+\]", "\x02")
        bare = F.regexp_replace(bare, "\x02", "[]")
        bare = F.regexp_replace(bare, r"\[([^\[\]]*)\[\]([^\[\]]*)\]", "[]")
    even = F.length(F.regexp_replace(bare, r"[^(]", "")) == F.length(F.regexp_replace(bare, r"[^)]", ""))
    path = rf"\s*{_LOOSE_PATH}\s*"
    # A function of paths, such as count(//a) or normalize-space(//h1), is a valid literal.
    call = rf"\s*[A-Za-z][\w\-]*\(\s*(?:{path}(?:,\s*{path})*)?\)\s*"
    return closed & even & bare.rlike(rf"^(?:(?:{path})(?:\|{path})*|{call})\z")


def _compile(df: DataFrame, *keep: str) -> DataFrame:
    """The columns come out of a generator so that filters on them are not rewritten in
    terms of the long expressions."""
    text = strip(F.col("xpath"))
    whole = text.rlike(r"^string\(.*\)\z")
    reading = r"(//?)(@[\w:\-]+|text\(\))\z"
    df = df.withColumn(
        "_path", F.when(whole, F.regexp_extract(text, r"^string\(\s*(.*?)\s*\)\z", 1)).otherwise(text)
    ).withColumns({
        "_steps": F.regexp_extract_all(F.regexp_replace("_path", reading, ""), F.lit(_STEP), F.lit(0)),
        "_last": F.regexp_extract("_path", reading, 2),
        "_below": F.regexp_extract("_path", reading, 1) == "//",
    })
    # `//a//@href` also reads elements below a: the leaf step is then any element.
    last_step = F.try_element_at("_steps", F.lit(-1))
    df = df.withColumns({
        "_inner": F.when(F.col("_below"), F.col("_steps")).otherwise(
            F.slice("_steps", 1, F.greatest(F.size("_steps") - 1, F.lit(0)))
        ),
        "_leaf": F.when(F.col("_below"), F.lit("//*")).otherwise(last_step),
    }).withColumn("_conds", F.filter(_conditions(F.col("_leaf")), _not_class))
    far = F.exists("_inner", lambda s: F.exists(_conditions(s), _not_class))
    problem = (
        F.when(text == "", "Invalid expression")
        .when(
            ~F.col("_path").rlike(f"^{_PATH}\\z"),
            F.concat(F.when(_well_formed(text), UNSUPPORTED).otherwise("Invalid expression: "), text),
        )
        .when(
            far | ((F.col("_last") == "text()") & (F.size("_conds") > 0)),
            F.concat(F.lit(UNSUPPORTED), text),
        )
    )
    pattern = F.concat(
        F.array_join(F.transform("_steps", _step_pattern), ""),
        F.when(F.col("_below"), _ANY_STEPS).otherwise(""), F.lit("\\z"),
    )
    return df.select(*keep, "xpath", F.inline(F.array(F.struct(
        pattern.alias("pattern"),
        F.regexp_extract("_leaf", r"^//?([^\[]+)", 1).alias("leaf"),
        F.col("_last").alias("terminal"),
        F.coalesce(whole, F.lit(False)).alias("whole"),
        F.col("_conds").alias("conds"),
        problem.alias("problem"),
    ))))


def _not_class(cond: Column) -> Column:
    return cond["attr"] != "class"


def check_syntax(selectors: DataFrame) -> DataFrame:
    """Selectors with `problem`: null, or why they cannot be run. Never fails."""
    return compile_selectors(selectors).drop("pattern", "leaf", "terminal", "whole", "conds")


def _holds(conds: Column, attrs: Column) -> Column:
    """Attribute tests; text() tests are left to a join (``_text_tests``) and hold here."""
    def test(c: Column) -> Column:
        v = attrs[c["attr"]]
        return F.coalesce(
            F.when(c["op"] == "contains", v.contains(c["value"]))
            .when(c["op"] == "starts-with", v.startswith(c["value"]))
            .when(c["op"] == "equals", v == c["value"])
            .when(c["op"] == "text", F.lit(True))
            .otherwise(v.isNotNull()),
            F.lit(False),
        )
    return F.forall(conds, test)


def _first_only(matches: DataFrame, keys: list[str]) -> DataFrame:
    """string(...) has one value per page, that of the first match."""
    first = F.min("node_id").over(Window.partitionBy(*keys))
    return matches.withColumn("_first", first).filter(~F.col("whole") | (F.col("node_id") == F.col("_first"))).drop("_first", "whole")


def eval_selectors(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Run a fixed set of named selectors on every page: (page_id, field, node_id, value).

    One scan. Attribute and text() values come straight from their rows. For element values
    each text node finds the matching elements among its own ancestors, so only text below
    a match is shuffled.
    """
    spark = nodes.sparkSession
    named = [(f, x) for f, x in selectors.items()]
    compiled = _compile(spark.createDataFrame(named, "field STRING, xpath STRING"), "field").collect()     # one row per selector written by the caller
    bad = [r for r in compiled if r["problem"]] + [
        {"problem": "text() tests run in match_rows: " + r["xpath"]} for r in compiled if any(c["op"] == "text" for c in r["conds"])]
    if bad:
        raise ValueError("; ".join(r["problem"] for r in bad))

    trail, kind = F.col("trail"), F.col("kind")
    shape = "array<struct<field:string,node_id:int,pos:int,chunk:string,whole:boolean>>"

    def hit(row, node_id: Column, chunk: Column) -> Column:
        return F.struct(
            F.lit(row["field"]).alias("field"), node_id.alias("node_id"),
            F.col("node_id").alias("pos"), chunk.alias("chunk"), F.lit(row["whole"]).alias("whole"),
        )

    hits, wanted, gathers = [], F.lit(False), False
    for row in compiled:
        # The pattern spells its leaf step's tag: a plain search for it spares most rows the pattern.
        near = F.lit(True) if row["leaf"] == "*" else trail.contains(f"/{row['leaf']}|")
        on_trail = near & trail.rlike(row["pattern"])
        own = F.lit(True)
        for c in row["conds"]:
            cond = F.struct(*[F.lit(c[k]).alias(k) for k in ("op", "attr", "value")])
            own = own & _holds(F.array(cond), F.col("attrs"))
        if row["terminal"] == "text()":
            found = (kind == "text") & on_trail
            hits.append(F.when(found, F.array(hit(row, F.col("node_id"), F.col("text")))))
        elif row["terminal"]:
            name = row["terminal"][1:]
            found = (kind == "el") & on_trail & own & F.map_contains_key("attrs", name)
            hits.append(F.when(found, F.array(hit(row, F.col("node_id"), F.col("attrs")[name]))))
        else:
            gathers = True
            element = (kind == "el") & on_trail & own
            below = (kind == "text") & near & trail.rlike(row["pattern"].removesuffix("\\z") + "(?:/|\\z)")
            found = element | below
            depths = F.filter(
                F.sequence(F.lit(1), F.size("anc")),
                lambda d: F.call_function("substring_index", trail, F.lit("/"), d + 1).rlike(row["pattern"]),
            )
            hits.append(
                F.when(element, F.array(hit(row, F.col("node_id"), F.lit(""))))
                .when(below, F.transform(depths, lambda d: hit(row, F.element_at("anc", d), F.col("text"))))
            )
        wanted = wanted | found
    empty = F.array().cast(shape)
    every = F.flatten(F.array(*[F.coalesce(h.cast(shape), empty) for h in hits]))
    rows = nodes.filter(wanted).select("page_id", F.inline(every))
    if gathers:
        rows = rows.groupBy("page_id", "field", "node_id", "whole").agg(
            F.expr("listagg(chunk, '') within group (order by pos)").alias("chunk"),
            # Text below an element that failed an attribute test has no row of its own.
            F.min("pos").alias("pos"),
        )
        elements = [r["field"] for r in compiled if not r["terminal"]]
        rows = rows.filter(~F.col("field").isin(elements) | (F.col("pos") == F.col("node_id")))
    rows = rows.select("page_id", "field", "node_id", strip(F.col("chunk")).alias("value"), "whole")
    if any(r["whole"] for r in compiled):
        return _first_only(rows, ["page_id", "field"])
    return rows.drop("whole")


def eval_selector(nodes: DataFrame, xpath: str) -> DataFrame:
    """(page_id, node_id, value) of one selector on every page."""
    return eval_selectors(nodes, {"_": xpath}).drop("field")


def _of_class() -> list[Column]:
    """Nodes of a page that share kind, tag and way from the root are of one class, named by two
    independent hashes."""
    return [F.xxhash64("kind", "tag", "trail").alias("_class"), F.hash("trail", "tag", "kind").alias("_check")]


def match_sets(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors of a page that read the same nodes in the same way, as one row: (page_id, set_id,
    classes, terminal, whole, conds, members), where members are (xpath, …) of ``selectors``.

    ``selectors`` (page_id, xpath, …) has each selector of a page once; broken ones and those that
    fit nowhere give nothing. A page's nodes share few ways from the root: selectors are tested
    on the distinct ways. Many candidates of a page turn out to be spellings of the same set, so
    later steps meet its nodes once instead of once for each spelling. Written, being read twice.
    """
    columns = [c for c in selectors.columns if c != "page_id"]
    compiled = compile_selectors(selectors).filter(F.col("problem").isNull()).drop("problem")
    ways = (
        nodes.filter(F.col("kind").isin("el", "text")).select("page_id", "kind", "tag", "trail", *_of_class()).distinct()
        .withColumn("_end", F.substring_index(F.substring_index("trail", "/", -1), "|", 1))
    )
    reads_text = F.col("terminal") == "text()"
    # A pattern ends with its leaf step, so only ways that end in that tag need the pattern: they
    # meet by it, each way once under its tag and once for selectors of any tag.
    compiled = compiled.withColumns({"_text": reads_text, "_tag": F.coalesce("leaf", F.lit("*"))})
    ways = ways.withColumns({"_text": F.col("kind") == "text", "_tag": F.explode(F.array(F.coalesce("tag", "_end"), F.lit("*")))})
    ends = F.col("leaf").isNull() | (F.col("leaf") == "*") | (F.col("leaf") == F.col("_end"))
    of_kind = F.when(F.col("kind") == "text", reads_text).otherwise(
        ~reads_text & ((F.col("leaf") == "*") | (F.col("leaf") == F.col("tag")))
    )
    # regexp_instr keeps its compiled pattern while the pattern stays the same, which it
    # does along the ways of a page: the selectors are the streamed side of the join.
    fitting = compiled.join(ways, ["page_id", "_text", "_tag"]).filter(ends & of_kind & (F.regexp_instr("trail", F.col("pattern")) > 0))
    how = ["terminal", "whole", "conds"]
    each = fitting.groupBy("page_id", "xpath").agg(
        F.array_sort(F.collect_list(F.struct("_class", "_check"))).alias("classes"),
        *[F.first(c).alias(c) for c in [*how, *columns] if c != "xpath"],
    )
    sets = each.groupBy("page_id", "classes", *how).agg(
        F.min("xpath").alias("_least"), F.collect_list(F.struct(*columns)).alias("members")
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("_least"))
    return stage(sets.withColumn("set_id", number).drop("_least"), "match-sets")


def set_rows(nodes: DataFrame, sets: DataFrame, values: bool = True) -> DataFrame:
    """The nodes of each of ``match_sets``: (page_id, set_id, …, node_id, anc, whole[, value]),
    with the columns that were added to ``sets``."""
    base = nodes.filter(F.col("kind").isin("el", "text")).select(
        "page_id", "node_id", "attrs", "text", "text_from", "text_to", "anc", *_of_class(),
    ).withColumnRenamed("_check", "_same")
    extra = [c for c in sets.columns if c not in ("page_id", "classes", "terminal", "whole", "conds", "members")]
    picked = sets.select("page_id", "terminal", "whole", "conds", *extra, F.inline("classes"))
    reads_text = F.col("terminal") == "text()"
    name = F.substring("terminal", 2, 1 << 20)
    has = (F.col("terminal") == "") | reads_text | F.map_contains_key("attrs", name)
    holds = (F.size("conds") == 0) | _holds(F.col("conds"), F.col("attrs"))
    matches = picked.join(base, ["page_id", "_class"]).filter((F.col("_check") == F.col("_same")) & has & holds)
    matches = _text_tests(matches, sets, nodes)
    if not values:
        return matches.select("page_id", *extra, "node_id", "anc", "whole")
    matches = matches.select(
        "page_id", *extra, "node_id", "anc", "whole", "text_from", "text_to",
        F.when(reads_text, F.col("text")).when(F.col("terminal") != "", F.col("attrs")[name]).alias("direct"),
    )
    return text_content(matches, nodes).select(
        "page_id", *extra, "node_id", "anc", "whole", F.coalesce(strip(F.col("direct")), F.col("value")).alias("value")
    )


def match_rows(nodes: DataFrame, selectors: DataFrame, values: bool = True) -> DataFrame:
    """Run each page's own selectors: (page_id, xpath, node_id, anc, whole[, value]).

    ``selectors`` (page_id, xpath) may hold any number of pages with a few selectors each;
    equal selectors of a page are run once, broken ones give nothing. What a selector finds
    follows from its set (``match_sets``) and the kind, tag and attributes of the nodes. Of
    `whole` selectors only the first match counts; that is left to the caller.
    """
    sets = match_sets(nodes, selectors.select("page_id", "xpath").distinct())
    rows = set_rows(nodes, sets.withColumn("xpaths", F.col("members.xpath")), values)
    return rows.select("page_id", F.explode("xpaths").alias("xpath"), *[c for c in rows.columns if c not in ("page_id", "set_id", "xpaths")])


def _text_tests(matches: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep matches whose text() tests all hold: each is met by a child text node equal to its
    value. Which elements meet them follows from the selectors' tests and the text rows alone
    (on page and text), so the matches are read once and meet that small table in one left join;
    they need not be sorted for it where no selector has such a test."""
    tests = F.filter("conds", lambda c: c["op"] == "text")
    asking = sets.filter(F.size(tests) > 0)
    if asking.isEmpty():
        return matches
    asked = asking.select("page_id", "set_id", F.posexplode(tests).alias("_i", "_c")).select(
        "page_id", "set_id", "_i", F.col("_c.value").alias("_tv"))
    texts = nodes.filter(F.col("kind") == "text").select("page_id", F.col("parent_id").alias("node_id"), F.col("text").alias("_tv"))
    met = asked.join(texts, ["page_id", "_tv"]).groupBy("page_id", "set_id", "node_id").agg(F.countDistinct("_i").alias("_met"))
    return matches.join(met, ["page_id", "set_id", "node_id"], "left").filter(
        (F.size(tests) == 0) | (F.col("_met") == F.size(tests))).drop("_met")


def eval_selector_table(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """Matches of each page's own selectors: (page_id, xpath, node_id, anc, value)."""
    return _first_only(match_rows(nodes, selectors), ["page_id", "xpath"])


def eval_selector_literal(xml: DataFrame, xpath: str) -> DataFrame:
    """Any XPath 1.0 literal with Spark's own functions on ``page_xml`` output.

    (page_id, n, first): number of matched nodes and the first one's string value.
    """
    return xml.select(
        "page_id",
        F.xpath_int("xml", F.lit(f"count({xpath})")).alias("n"),
        strip(F.xpath_string("xml", F.lit(xpath))).alias("first"),
    )


def match_counts(pages: DataFrame, fields: list[str], matches: DataFrame) -> DataFrame:
    """Matches per page and field, 0 where a page has none: (page_id, field, match_count)."""
    grid = pages.select("page_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    counts = matches.groupBy("page_id", "field").agg(F.count("*").alias("match_count"))
    return grid.join(counts, ["page_id", "field"], "left").fillna(0, ["match_count"])


def element_selector(xpath: Column) -> Column:
    """The selector of the elements: without string(...) and a last /text() or /@name."""
    return F.regexp_replace(
        F.regexp_replace(strip(xpath), r"^string\((.*)\)$", "$1"), r"/(text\(\)|@\w+)$", ""
    )
