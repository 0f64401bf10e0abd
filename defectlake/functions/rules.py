"""The code-defect rules, as Column expressions over the nodes and tokens of a source.

A rule gives an array of findings: place in the tree, line, column, and evidence as JSON. All
read only the row's own ``nodes``, ``tokens`` and source lines, by position, so no rule
shuffles anything.
"""

from __future__ import annotations

import builtins
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
OPPOSITE = {"Eq": "NotEq", "NotEq": "Eq", "Lt": "GtE", "GtE": "Lt", "LtE": "Gt", "Gt": "LtE"}
INDEX_WORDS = ("index", "idx", "position", "pos")
COUNTERS, SIZES, COORDINATES = ("i", "j", "k"), ("n", "m"), ("x", "y", "z")
DEMO_NAMES = ("x", "y", "z", "i", "j", "tmp", "foo", "bar", "a", "b")
SPACED = tuple("= += -= *= /= //= %= **= == != < <= > >= + - * / // % ** and or in is".split())
BEFORE_UNARY = ("return", "yield", "if", "elif", "while", "for", "in", "and", "or", "not")
BRACKETS = {"(": ")", "[": "]", "{": "}"}
UNSAFE_CALLS = ("__import__", "compile", "eval", "exec", "open")
UNSAFE_MODULES = ("ctypes", "importlib", "os", "pathlib", "requests", "shutil", "socket", "subprocess", "sys", "urllib")
MAX_SPREAD, MIN_WEIGHT = 20, 8
#: What the module of built-ins has, with what every module has.
BUILT_IN = tuple(sorted({*dir(builtins), *dir(type(builtins))}))
ACTING = ("Call", "Await", "Yield", "YieldFrom", "Attribute", "NamedExpr")
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
SCOPES = (*FUNCTIONS, "Lambda")
WEIGHTS = {"Name": 2, "Subscript": 4, "BinOp": 2, "BoolOp": 2, "Call": 2, "Compare": 2, "UnaryOp": 3}
CONTROL = ("If", "For", "While", "Try", "With")

#: Rules by name; those of OPTIONAL run only when asked for.
RULES: dict[str, Callable[[tuple[str, ...]], Column]] = {}
OPTIONAL = ("redundant_for", "non_descriptive_naming", "unused_variable", "redundant_boolean_comparison", "excessive_nesting")
EVIDENCE = "array<struct<line: int, column: int, evidence: string>>"


def rule(f: Callable) -> Callable:
    RULES[f.__name__] = f
    return f


# Walking


def node(at: Column) -> Column:
    """The node at a place; null where there is none."""
    return F.get("nodes", at)


def parent(n: Column) -> Column:
    return node(n["up"])


def first(n: Column) -> Column:
    """A node's first child."""
    return node(n["head"])


def following(n: Column) -> Column:
    """The next child of a node's parent."""
    return node(n["next"])


def let(value: Column, body: Callable) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(lo: Column, hi: Column) -> Column:
    """The nodes from one place up to another."""
    return F.slice("nodes", lo + 1, F.greatest(hi - lo, F.lit(0)))


def within(n: Column) -> Column:
    """A node and all below it."""
    return span(n["id"], n["last"])


def around(inner: Column, among: Column) -> Column:
    """Those of ``among`` that hold a node, outermost first."""
    return F.filter(among, lambda a: (a["id"] < inner["id"]) & (inner["id"] < a["last"]))


def of(*kinds: str, over: Column | str = "nodes") -> Column:
    return F.filter(over, lambda n: n["kind"].isin(*kinds))


def is_(n: Column, *kinds: str) -> Column:
    return F.coalesce(n["kind"].isin(*kinds), F.lit(False))


def acts(part: Column) -> Column:
    """Whether some node may act: a call, a wait, an attribute or an inner assignment."""
    return F.exists(part, lambda n: n["kind"].isin(*ACTING))


def calls(n: Column, name: str) -> Column:
    return is_(n, "Call") & F.coalesce((first(n)["kind"] == "Name") & (first(n)["name"] == name), F.lit(False))


def only_argument(call: Column) -> Column:
    """The argument of a call with one positional argument."""
    argument = following(first(call))
    return F.when((argument["slot"] == "args") & (argument["siblings"] == 1), argument)


def truth(n: Column) -> Column:
    return F.coalesce(n["op"] == "bool", F.lit(False))


def loop_body(n: Column) -> Column:
    """The first statement of a loop or an if."""
    return node(n["start"])


def body_of(n: Column) -> Column:
    return span(n["start"], n["mid"])


def otherwise(n: Column) -> Column:
    """The first statement of an else part."""
    return F.when(n["mid"] < n["last"], node(n["mid"]))


def alone(n: Column, *kinds: str) -> Column:
    """Whether a statement is of these kinds and the only one of its body."""
    return F.coalesce(n["kind"].isin(*kinds) & (n["siblings"] == 1), F.lit(False))


# Findings


def found(n: Column, **evidence: Column) -> Column:
    """A finding at a node; findings sort breadth first."""
    text = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])) if evidence else F.lit("{}")
    return F.struct(n["depth"].alias("depth"), n["id"].alias("at"), n["line"].alias("line"), n["column"].alias("column"), text.alias("evidence"))


def findings(over: Column, which: Callable, finding: Callable) -> Column:
    return F.sort_array(F.transform(F.filter(over, which), finding))


def words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def pick(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


# Conditions


def elifs() -> Column:
    """The elif parts, each once for every if that a chain up to it can start from."""
    part = F.filter("nodes", lambda n: alone(n, "If") & (n["slot"] == "orelse") & is_(parent(n), "If") & (n["op"] == "elif"))
    return F.flatten(F.transform(part, lambda n: F.array_repeat(n, n["chain"])))


@rule
def redundant_if_else(_: tuple[str, ...]) -> Column:
    def returns(n: Column, value: str) -> Column:
        return alone(n, "Return") & truth(first(n)) & (first(n)["name"] == value)

    return findings(of("If"), lambda n: returns(loop_body(n), "True") & returns(otherwise(n), "False"), lambda n: found(n, condition=first(n)["text"]))


@rule
def redundant_comparison(_: tuple[str, ...]) -> Column:
    """Comparisons of a boolean with True or False, read in order with the names that are boolean by then."""
    bindings = F.filter("nodes", lambda n: n["kind"].isin("Assign", "AnnAssign"))
    compared = F.filter("nodes", lambda n: (n["kind"] == "Compare") & n["op"].isin("Eq", "NotEq") & (truth(first(n)) | truth(following(first(n)))))
    hidden = lambda c, bound: F.exists(bound, lambda a: (a["id"] < c["id"]) & (c["id"] < a["mid"]))
    compared = let(bindings, lambda bound: F.filter(compared, lambda c: ~hidden(c, bound)))
    # An assignment counts from the end of its value on.
    events = F.sort_array(F.concat(
        F.transform(F.filter(bindings, lambda a: a["mid"] < a["last"]), lambda a: F.struct((node(a["mid"])["last"] * 2).alias("when"), a["id"].alias("id"))),
        F.transform(compared, lambda c: F.struct((c["id"] * 2 + 1).alias("when"), c["id"].alias("id"))),
    ))

    def boolean(n: Column, flags: Column) -> Column:
        plain = truth(n) | is_(n, "Compare") | (is_(n, "UnaryOp") & (n["op"] == "Not")) | calls(n, "bool")
        return F.when(n["kind"] == "Name", F.array_contains(flags, n["name"])).otherwise(plain)

    def step(state: Column, event: Column) -> Column:
        n, flags, hits = node(event["id"]), state["flags"], state["hits"]
        left, right = first(n), following(first(n))
        hit = truth(left) & boolean(right, flags) | truth(right) & boolean(left, flags)
        bound = F.transform(F.filter(span(n["id"] + 1, n["mid"]), lambda x: (x["kind"] == "Name") & (x["op"] == "Store") & ~is_(parent(x), "Starred")), lambda x: x["name"])
        after = F.when(boolean(node(n["mid"]), flags), F.array_union(flags, bound)).otherwise(F.array_except(flags, bound))
        is_comparison = n["kind"] == "Compare"
        return F.struct(F.when(is_comparison, flags).otherwise(after).alias("flags"), F.when(is_comparison & hit, F.array_append(hits, n["id"])).otherwise(hits).alias("hits"))

    nothing = F.struct(words(()).alias("flags"), F.array().cast("array<int>").alias("hits"))
    hits = F.aggregate(events, nothing, step, lambda state: state["hits"])
    operand = lambda n: F.when(truth(first(n)), following(first(n))["text"]).otherwise(first(n)["text"])
    return F.transform(hits, lambda at: found(node(at), operand=F.coalesce(operand(node(at)), node(at)["text"])))


@rule
def redundant_not(_: tuple[str, ...]) -> Column:
    return findings(of("UnaryOp"), lambda n: (n["op"] == "Not") & is_(first(n), "Compare") & first(n)["op"].isin(*OPPOSITE), lambda n: found(n, comparison=first(n)["text"], inverse=pick(OPPOSITE, first(n)["op"])))


@rule
def duplicate_if(_: tuple[str, ...]) -> Column:
    return findings(elifs(), lambda b: (parent(b)["body"] == b["body"]) & ~acts(body_of(parent(b))) & ~acts(body_of(b)), lambda b: found(b, lines=F.array(parent(b)["line"], b["line"])))


@rule
def else_if(_: tuple[str, ...]) -> Column:
    return findings(of("If"), lambda n: alone(n, "If") & (n["slot"] == "orelse") & is_(parent(n), "If") & (n["op"] == "if"), lambda n: found(n, outer_line=parent(n)["line"]))


@rule
def nested_if(_: tuple[str, ...]) -> Column:
    plain = lambda n: n["mid"] == n["last"]
    joined = lambda n: F.concat(F.lit("("), first(parent(n))["text"], F.lit(") and ("), first(n)["text"], F.lit(")"))
    which = lambda n: alone(n, "If") & (n["slot"] == "body") & is_(parent(n), "If") & plain(n) & plain(parent(n)) & ~acts(within(first(n))) & ~acts(within(first(parent(n))))
    return findings(of("If"), which, lambda n: found(n, outer_line=parent(n)["line"], joined=joined(n)))


@rule
def redundant_elif(_: tuple[str, ...]) -> Column:
    def opposed(x: Column, y: Column) -> Column:
        same = lambda a, b: a["form"] == b["form"]
        return is_(x, "Compare") & is_(y, "Compare") & (pick(OPPOSITE, x["op"]) == y["op"]) & same(first(x), first(y)) & same(following(first(x)), following(first(y))) & ~acts(within(x)) & ~acts(within(y))

    return findings(elifs(), lambda b: opposed(first(parent(b)), first(b)), lambda b: found(b, before=first(parent(b))["text"], after=first(b)["text"]))


@rule
def empty_if(_: tuple[str, ...]) -> Column:
    idle = lambda n: alone(n, "Pass")
    where = lambda n: F.when(idle(loop_body(n)), loop_body(n)).otherwise(otherwise(n))
    return findings(of("If"), lambda n: (n["mid"] < n["last"]) & (idle(loop_body(n)) != idle(otherwise(n))), lambda n: found(where(n), branch=F.when(idle(loop_body(n)), "if").otherwise("else")))


# Collections


@rule
def redundant_indexing(_: tuple[str, ...]) -> Column:
    sequence = lambda n: only_argument(only_argument(following(first(n))))
    uses = lambda n: F.filter(body_of(n), lambda u: (u["kind"] == "Name") & (u["name"] == first(n)["name"]))

    def by_position(n: Column) -> Column:
        return is_(first(n), "Name") & calls(following(first(n)), "range") & calls(only_argument(following(first(n))), "len") & sequence(n).isNotNull()

    def reads(u: Column, n: Column) -> Column:
        apart = F.exists(of(*SCOPES, over=within(n)), lambda s: (s["id"] < u["id"]) & (u["id"] < s["last"]))
        at = parent(u)
        return (u["op"] == "Load") & is_(at, "Subscript") & (u["slot"] == "slice") & (at["op"] == "Load") & (first(at)["form"] == sequence(n)["form"]) & ~apart

    def kept(n: Column) -> Column:
        return ~F.exists(within(n), lambda s: is_(s, "Subscript") & (s["op"] != "Load") & (first(s)["form"] == sequence(n)["form"]))

    return findings(F.filter(of("For"), by_position), lambda n: (F.size(uses(n)) > 0) & F.forall(uses(n), lambda u: reads(u, n)) & kept(n), lambda n: found(n, index=first(n)["name"], sequence=sequence(n)["text"], reads=F.size(uses(n))))


@rule
def misleading_iterator_name(_: tuple[str, ...]) -> Column:
    return findings(of("For"), lambda n: is_(first(n), "Name") & first(n)["name"].isin(*COUNTERS) & ~calls(following(first(n)), "range"), lambda n: found(first(n), name=first(n)["name"], over=following(first(n))["text"]))


@rule
def duplicate_expression(_: tuple[str, ...]) -> Column:
    weight = lambda n: F.aggregate(within(n), F.lit(0), lambda z, x: z + F.coalesce(pick(WEIGHTS, x["kind"]).cast("int"), F.lit(1)))
    heavy = F.filter("nodes", lambda n: n["kind"].isin("BinOp", "BoolOp", "Compare", "Subscript", "UnaryOp") & n["text"].isNotNull() & (n["last"] - n["id"] > 2) & ~acts(within(n)) & (weight(n) >= MIN_WEIGHT))
    # Each with the loop or function around it, or itself where there is none.
    region = lambda n, regions: F.coalesce(F.array_max(F.transform(around(n, regions), lambda r: r["id"])), n["id"])
    placed = let(of(*FUNCTIONS, "For", "While"), lambda regions: F.transform(heavy, lambda n: F.struct(n["depth"].alias("depth"), n["id"].alias("id"), n["form"].alias("form"), n["line"].alias("line"), region(n, regions).alias("region"))))
    same = lambda x, among: F.sort_array(F.filter(among, lambda y: (y["region"] == x["region"]) & (y["form"] == x["form"])))
    groups = let(placed, lambda among: F.array_distinct(F.transform(among, lambda x: same(x, among))))
    lines = lambda group: F.transform(group, lambda y: y["line"])
    leader = lambda group: node(F.get(group, F.lit(0))["id"])
    which = lambda group: (F.size(group) > 1) & (F.array_max(lines(group)) - F.array_min(lines(group)) <= MAX_SPREAD)
    return findings(groups, which, lambda group: found(leader(group), expression=leader(group)["text"], lines=lines(group)))


# Loops and assignments


@rule
def while_as_for(_: tuple[str, ...]) -> Column:
    exits = ("Break", "Return", "Continue")

    def leaves(n: Column) -> Column:
        """Whether a statement has an exit that comes before any inner function, breadth first."""
        deciding = F.transform(of(*exits, *SCOPES, over=within(n)), lambda x: F.struct(x["depth"], x["id"], x["kind"].alias("kind")))
        return F.coalesce(F.array_min(deciding)["kind"].isin(*exits), F.lit(False))

    def steady(n: Column) -> Column:
        test = first(n)
        bound, name = following(first(test)), first(test)["name"]
        onward = F.when(test["op"].isin("Lt", "LtE"), n["value"] > 0).when(test["op"].isin("Gt", "GtE"), n["value"] < 0)
        moved = F.transform(F.filter(body_of(n), lambda x: (x["kind"] == "Name") & (x["op"] != "Load")), lambda x: x["name"])
        asked = F.transform(of("Name", over=within(bound)), lambda x: x["name"])
        out = F.exists(F.filter(body_of(n), lambda x: x["up"] == n["id"]), leaves)
        return is_(test, "Compare") & is_(first(test), "Name") & onward & ~out & (F.size(F.array_intersect(F.array_except(moved, F.array(name)), asked)) == 0)

    # A whole step is shown without its fraction.
    step = lambda n: F.when(n["value"] == F.floor(n["value"]), n["value"].cast("long").cast("string")).otherwise(n["value"].cast("string"))
    return findings(of("While"), lambda n: n["value"].isNotNull() & steady(n), lambda n: found(n, name=first(first(n))["name"], step=step(n), form=n["op"]))


@rule
def redundant_for(_: tuple[str, ...]) -> Column:
    def size(e: Column) -> Column:
        given = F.filter(within(e), lambda x: (x["up"] == e["id"]) & (x["slot"] == "args"))
        whole = F.transform(given, lambda x: F.when(is_(x, "Constant", "UnaryOp", "BinOp") & (x["value"] == F.floor(x["value"])), x["value"]))
        n = F.size(given)
        start, stop = F.when(n == 1, 0.0).otherwise(F.get(whole, F.lit(0))), F.when(n == 1, F.get(whole, F.lit(0))).otherwise(F.get(whole, F.lit(1)))
        step = F.when(n < 3, 1.0).otherwise(F.get(whole, F.lit(2)))
        long = F.when(n.between(1, 3) & (step != 0) & (stop - start).isNotNull(), F.greatest(F.lit(0.0), F.ceil(F.try_divide(stop - start, step))))
        parts = F.size(F.filter(within(e), lambda x: (x["up"] == e["id"]) & (x["slot"] == "elts")))
        return F.when(calls(e, "range"), long).when(is_(e, "List", "Tuple", "Set") & (F.size(of("Call", over=within(e))) == 0), parts).cast("long")

    return findings(of("For"), lambda n: size(following(first(n))) < 2, lambda n: found(n, iterable=following(first(n))["text"], size=size(following(first(n)))))


@rule
def augmentable_assignment(_: tuple[str, ...]) -> Column:
    operators = ("Add", "Sub", "Mult", "Div", "FloorDiv", "Mod", "Pow")

    def grows(n: Column) -> Column:
        to, value = first(n), node(n["mid"])
        once = F.size(F.filter(within(value), lambda x: (x["kind"] == "Name") & (x["name"] == to["name"]))) == 1
        return alone(to, "Name") & (to["slot"] == "targets") & is_(value, "BinOp") & value["op"].isin(*operators) & is_(first(value), "Name") & (first(value)["name"] == to["name"]) & once

    return findings(of("Assign"), grows, lambda n: found(n, name=first(n)["name"], operator=node(n["mid"])["op"]))


# Literals and names


@rule
def magic_number(_: tuple[str, ...]) -> Column:
    deciding = F.filter("nodes", lambda a: a["kind"].isin("Compare", "BinOp", "List", "Tuple", "Set", "Dict", "Subscript") | calls(a, "range"))
    signed = lambda n: is_(parent(n), "UnaryOp") & parent(n)["op"].isin("USub", "UAdd")

    def usual(n: Column) -> Column:
        """Whether -1 stands for a position."""
        return is_(parent(n), "Subscript") | is_(parent(n), "Compare") & F.exists(within(parent(n)), lambda x: is_(x, "Name") & F.lower(x["name"]).isin(*INDEX_WORDS))

    numbers = F.filter("nodes", lambda n: n["number"].isNotNull() & ~n["value"].isin(0.0, 1.0) & ~(is_(n, "Constant") & signed(n)) & ~(is_(n, "UnaryOp") & (n["value"] == -1) & usual(n)))
    nearest = lambda n, among: F.array_max(F.transform(around(n, among), lambda a: F.struct(a["id"].alias("id"), a["kind"].alias("kind"))))["kind"]
    context = lambda n, among: pick({"Compare": "comparison", "BinOp": "computation"}, nearest(n, among))
    return let(deciding, lambda among: findings(numbers, lambda n: context(n, among).isNotNull(), lambda n: found(n, value=n["number"], context=context(n, among))))


def first_places(bound: Column) -> Column:
    """Of bound names at one place the first, breadth first."""
    order = lambda n: F.struct(n["depth"], n["id"])
    earlier = lambda n, m: (m["name"] == n["name"]) & (m["line"] == n["line"]) & (m["column"] == n["column"]) & (order(m) < order(n))
    return let(bound, lambda some: F.filter(some, lambda n: ~F.exists(some, lambda m: earlier(n, m))))


def binds(n: Column) -> Column:
    return (n["kind"] == "arg") | (n["kind"] == "Name") & (n["op"] == "Store")


@rule
def one_letter_name(required: tuple[str, ...]) -> Column:
    letters = (*COUNTERS, *SIZES, *COORDINATES)
    used = F.filter("nodes", lambda n: (n["kind"] == "Name") & (n["op"] == "Load") & n["name"].isin(*letters))
    moved = F.transform(F.filter("nodes", lambda a: (a["kind"] == "AugAssign") & a["op"].isin("Add", "Sub") & is_(first(a), "Name")), lambda a: first(a)["name"])

    def fits(n: Column, loads: Column) -> Column:
        some_load = lambda how: F.exists(loads, lambda u: (u["name"] == n["name"]) & how(u))
        counter = F.when(is_(parent(n), "For") & (n["slot"] == "target"), calls(following(n), "range")).otherwise(some_load(lambda u: is_(parent(u), "Subscript") & (u["slot"] == "slice")) | F.array_contains(moved, n["name"]))
        size = some_load(lambda u: is_(parent(u), "Compare") | calls(parent(u), "range"))
        coordinate = some_load(lambda u: is_(parent(u), "BinOp", "UnaryOp", "Compare"))
        return F.when(n["name"].isin(*COUNTERS), counter).when(n["name"].isin(*SIZES), size).when(n["name"].isin(*COORDINATES), coordinate).otherwise(False)

    short = F.filter("nodes", lambda n: binds(n) & (F.length(n["name"]) == 1) & (n["name"] != "_") & ~F.array_contains(words(required), n["name"]))
    return let(used, lambda loads: findings(first_places(short), lambda n: ~fits(n, loads), lambda n: found(n, name=n["name"])))


@rule
def built_in_name(_: tuple[str, ...]) -> Column:
    bound = F.filter("nodes", lambda n: (binds(n) | n["kind"].isin(*FUNCTIONS, "ClassDef", "alias")) & n["name"].isin(*BUILT_IN))
    return findings(first_places(bound), lambda n: F.lit(True), lambda n: found(n, name=n["name"], kind=n["kind"]))


# Layout


def _token_findings() -> Column:
    """What is wrong between each token and the next, by rules on the pair and the columns between them."""
    openers, closers = tuple(BRACKETS), tuple(BRACKETS.values())
    before = lambda at: F.when(at > 0, F.get("tokens", at - 1)["text"])
    is_sign = lambda t, prior: t["text"].isin("+", "-") & (prior.isNull() | prior.isin(*openers, ",", ":", "=", *BEFORE_UNARY))
    marked = F.transform("tokens", lambda t, at: F.struct(t["text"].alias("text"), t["is_name"].alias("is_name"), t["line"].alias("line"), t["column"].alias("column"), t["end_line"].alias("end_line"), t["end_column"].alias("end_column"), (t["text"].isin(*SPACED) & ~is_sign(t, before(at))).alias("spaced")))

    def of_pair(a: Column, b: Column, gap: Column) -> Column:
        # What the two tokens are, if the gap is wrong for them, which is reported, and the rule's name.
        table = (
            (a["text"].isin(*openers) & (b["text"] != pick(BRACKETS, a["text"])), gap > 0, b, "space inside bracket"),
            (a["spaced"], gap != 1, a, "operator spacing"),
            ((a["text"] == ":") & ~b["text"].isin(",", *closers), gap == 0, b, "no space after colon"),
            (b["text"].isin(",", ";", ":"), gap > 0, b, "space before delimiter"),
            ((a["text"] == ",") & ~b["text"].isin(*closers), gap == 0, b, "no space after comma"),
            ((b["text"] == "(") & a["is_name"] & ~a["text"].isin(*BEFORE_UNARY), gap > 0, b, "space before call"),
            ((b["text"] == "[") & ~a["text"].isin("=", ",", ":"), gap > 0, b, "space before index"),
            (b["text"].isin(*closers) & (a["text"] != pick({c: o for o, c in BRACKETS.items()}, b["text"])), gap > 0, b, "space inside bracket"),
            (b["spaced"], gap != 1, b, "operator spacing"),
        )
        return F.array_compact(F.array(*[F.when(wrong & fits, _layout(t["line"], t["column"], rule=F.lit(name), token=t["text"])) for fits, wrong, t, name in table]))

    gap = lambda a, b: F.when(a["end_line"] == b["line"], b["column"] - a["end_column"]).otherwise(-1)
    pairs = let(marked, lambda t: F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"), gap(a, b).alias("gap"))))
    return F.flatten(F.transform(pairs, lambda p: of_pair(p["a"], p["b"], p["gap"])))


def _layout(line: Column, column: Column, **evidence: Column) -> Column:
    none = F.lit(0)
    return F.struct(none.alias("depth"), none.alias("at"), line.alias("line"), column.alias("column"), F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])).alias("evidence"))


def line_findings(line: Column, number: Column) -> Column:
    """What is wrong with one line: its indentation, and blanks at its end."""
    indent = F.regexp_extract(line, r"^[ \t]*", 0)
    tab = F.contains(indent, F.lit("\t"))
    end = F.length(F.regexp_replace(line, r"[ \t]+$", ""))
    table = ((tab, F.lit(0), "tab in indentation"), (~tab & (F.length(indent) % 4 != 0), F.lit(0), "indentation not by four"), (end < F.length(line), end, "trailing blanks"))
    return F.array_compact(F.array(*[F.when(holds, _layout(number, column, rule=F.lit(name))) for holds, column, name in table]))


#: Where Python ends a line.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


@rule
def inappropriate_formatting(_: tuple[str, ...]) -> Column:
    return F.concat(_token_findings(), F.flatten(F.transform("lines", lambda line, i: line_findings(line, i + 1))))


# Demonstration rules, one finding at most


def _first_of(over: Column, which: Callable, finding: Callable) -> Column:
    return F.slice(findings(over, which, finding), 1, 1)


@rule
def non_descriptive_naming(_: tuple[str, ...]) -> Column:
    return _first_of(of("Name"), lambda n: n["name"].isin(*DEMO_NAMES), lambda n: found(n, name=n["name"]))


@rule
def unused_variable(_: tuple[str, ...]) -> Column:
    read = F.transform(F.filter("nodes", lambda n: (n["kind"] == "Name") & (n["op"] == "Load")), lambda n: n["name"])
    return let(read, lambda names: _first_of(of("Name"), lambda n: (n["op"] == "Store") & ~F.array_contains(names, n["name"]), lambda n: found(n, name=n["name"])))


@rule
def redundant_boolean_comparison(_: tuple[str, ...]) -> Column:
    return _first_of(of("Compare"), lambda n: F.exists(within(n), lambda x: (x["up"] == n["id"]) & (x["slot"] == "comparators") & truth(x)), lambda n: found(n, comparison=n["text"]))


@rule
def excessive_nesting(_: tuple[str, ...]) -> Column:
    return let(of(*CONTROL), lambda controls: _first_of(controls, lambda n: F.size(around(n, controls)) > 1, lambda n: found(n)))


ACTIVE = tuple(name for name in RULES if name not in OPTIONAL)


def unsafe_reason() -> Column:
    """Why the first unsafe import or call, breadth first, is not allowed; null if there is none."""
    module = lambda name: F.split_part(name, F.lit("."), F.lit(1)).isin(*UNSAFE_MODULES)

    def reason(n: Column) -> Column:
        called, owner = first(n), first(first(n))
        return (
            F.when(n["kind"] == "ImportFrom", F.concat(F.lit("imports are not allowed: "), F.coalesce(n["name"], F.lit("."))))
            .when((n["kind"] == "Import") & module(called["text"]), F.concat(F.lit("imports are not allowed: "), called["text"]))
            .when((n["kind"] == "Call") & (called["kind"] == "Name") & called["name"].isin(*UNSAFE_CALLS), F.concat(F.lit("unsafe call is not allowed: "), called["name"]))
            .when((n["kind"] == "Call") & (called["kind"] == "Attribute") & is_(owner, "Name") & owner["name"].isin(*UNSAFE_MODULES), F.concat(F.lit("unsafe module access is not allowed: "), owner["name"]))
        )

    reasons = F.transform(of("Import", "ImportFrom", "Call"), lambda n: F.struct(n["depth"], n["id"], reason(n).alias("reason")))
    return F.array_min(F.filter(reasons, lambda r: r["reason"].isNotNull()))["reason"]
