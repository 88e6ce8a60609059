"""Rewrites of SQL tokens that take an expression's extent, or its types: three-valued IN, integer arithmetic, frames with EXCLUDE, measures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Words before a bracket that make no function call of it.
_NO_CALL = set("IN AND OR NOT WHEN THEN ELSE BY SELECT DISTINCT WHERE ON AS FROM VALUES EXISTS BETWEEN LIKE HAVING IS OVER UNION ALL ANY SOME LATERAL USING JOIN SET CASE RETURNING INTERSECT EXCEPT , = < > ( + - * / %".split())
_TYPED = {"DATE", "TIME", "TIMESTAMP", "TIMESTAMP_NTZ", "INTERVAL"}
_CLAUSES = {"SELECT": "SELECT", "FROM": "FROM", "WHERE": "WHERE", "HAVING": "WHERE", "ON": "WHERE", "GROUP": "ORDER", "ORDER": "ORDER", "JOIN": "FROM", "UNION": "SELECT", "INTERSECT": "SELECT", "EXCEPT": "SELECT"}
INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def closing(t: list[str], i: int) -> int:
    """Place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] in ("(", "[")) - (t[j] in (")", "]"))
        if depth == 0:
            return j
    raise ValueError("brackets don't match")


def opening(t: list[str], i: int) -> int:
    depth = 0
    for j in range(i, -1, -1):
        depth += (t[j] in (")", "]")) - (t[j] in ("(", "["))
        if depth == 0:
            return j
    raise ValueError("brackets don't match")


def split(t: list[str]) -> list[list[str]]:
    """Parts between commas outside brackets."""
    out: list[list[str]] = [[]]
    depth = 0
    for x in t:
        depth += (x in ("(", "[")) - (x in (")", "]"))
        if x == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return out


def up(t: list[str], i: int) -> str:
    return t[i].upper() if 0 <= i < len(t) else ""


def before(t: list[str], end: int) -> int:
    """Where the operand begins that ends before `end`: a name, literal, call (with OVER, FILTER, WITHIN GROUP), CASE or bracket."""
    i = end - 1
    if t[i] in (")", "]"):
        i = opening(t, i)
        if t[i] == "[":
            return before(t, i)
        if up(t, i - 1) in ("OVER", "FILTER"):
            return before(t, i - 1)
        if up(t, i - 1) == "GROUP" and up(t, i - 2) == "WITHIN":
            return before(t, i - 2)
        if i and up(t, i - 1) not in _NO_CALL and (t[i - 1][0].isalpha() or t[i - 1][0] in "_`"):
            i -= 1
    elif up(t, i) == "END":
        depth = 0
        while True:
            depth += (up(t, i) == "END") - (up(t, i) == "CASE")
            if depth == 0:
                break
            i -= 1
    elif t[i][0] == "'" and up(t, i - 1) in _TYPED:
        i -= 1
    elif i >= 1 and up(t, i - 1) == "OVER":
        return before(t, i - 1)
    while i >= 2 and t[i - 1] == ".":
        i -= 2
    return i


def after(t: list[str], i: int) -> int:
    """Where the operand ends that begins at i."""
    while t[i] in ("+", "-"):
        i += 1
    if up(t, i) == "CASE":
        depth = 0
        while True:
            depth += (up(t, i) == "CASE") - (up(t, i) == "END")
            i += 1
            if depth == 0:
                return i
    if up(t, i) in _TYPED and i + 1 < len(t) and t[i + 1][0] == "'":
        return i + 2
    if t[i] == "(":
        i = closing(t, i) + 1
    else:
        i += 1
        while i + 1 < len(t) and t[i] == ".":
            i += 2
        if i < len(t) and t[i] == "(":
            i = closing(t, i) + 1
    return tail(t, i)


def tail(t: list[str], i: int) -> int:
    """Where what belongs to a call ends: FILTER (..), WITHIN GROUP (..), OVER (..) or OVER name, and [..]."""
    while i < len(t):
        if t[i] == "[" or (up(t, i) in ("FILTER", "OVER") and i + 1 < len(t) and t[i + 1] == "("):
            i = closing(t, i + (t[i] != "[")) + 1
        elif up(t, i) == "WITHIN" and up(t, i + 1) == "GROUP":
            i = closing(t, i + 2) + 1
        elif up(t, i) == "OVER":
            i += 2
        else:
            break
    return i


# ---- x IN (SELECT ...) where its value is shown


def projected_in(t: list[str], clause: str = "SELECT") -> list[str]:
    """IN with a sub-query in a select list or an order: true, false or unknown, as the standard has it (Spark shows false for unknown).

    Of one column: a hash join for the hits, and two counts of the sub-query for the rest. Of several: unknown goes by a
    condition that is no equality, which Spark runs as a nested loop.
    """
    out: list[str] = []
    stack, i = [clause], 0
    while i < len(t):
        word = t[i].upper()
        if t[i] == "(":
            stack.append(stack[-1])
        elif t[i] == ")" and len(stack) > 1:
            stack.pop()
        elif word in _CLAUSES and not (word == "GROUP" and up(t, i - 1) == "WITHIN"):
            stack[-1] = _CLAUSES[word]
        if word == "IN" and stack[-1] in ("SELECT", "ORDER") and i + 2 < len(t) and t[i + 1] == "(" and up(t, i + 2) in ("SELECT", "WITH"):
            j = closing(t, i + 1)
            inner = projected_in(t[i + 2 : j])
            negated = bool(out) and out[-1].upper() == "NOT"
            if negated:
                out.pop()
            start = before(out, len(out))
            left = out[start:]
            del out[start:]
            row = left[0] == "(" or up(left, 0) in ("ROW", "STRUCT")
            items = split(left[1 + (left[0] != "(") : -1]) if row else [left]
            hit = [*left, "IN", "(", *inner, ")"]
            if len(items) == 1:
                of = lambda name, where=(): ["(", "SELECT", "count", "(", "*", ")", "FROM", "(", *inner, ")", "AS", name, *where, ")", ">", "0"]  # noqa: B023, E731
                unknown = [*items[0], "IS", "NULL", "AND", *of("__q"), "THEN", "NULL", "WHEN", *of("__q(__c)", ("WHERE", "__c", "IS", "NULL"))]
            else:
                names = [f"__c{k}" for k in range(len(items))]
                test = [x for k, c in enumerate(items) for x in (*(["AND"] if k else []), "(", *c, "=", names[k], "OR", *c, "IS", "NULL", "OR", names[k], "IS", "NULL", ")")]
                unknown = ["EXISTS", "(", "SELECT", "1", "FROM", "(", *inner, ")", "AS", f"__q({', '.join(names)})", "WHERE", *test, ")"]
            out += [*(["NOT"] if negated else []), "(", "CASE", "WHEN", *hit, "THEN", "TRUE", "WHEN", *unknown, "THEN", "NULL", "ELSE", "FALSE", "END", ")"]
            i = j + 1
            continue
        out.append(t[i])
        i += 1
    return out


# ---- integers


Decide = Callable[[str, str, str, str], str]


def _arithmetic(t: list[str], decide: Decide, kinds: tuple[str, ...]) -> list[str]:
    """t with each of kinds (division, AVG, SUM) as one token that decide(kind, left or argument, right, rest) gives."""
    out: list[str] = []
    i = 0
    while i < len(t):
        if t[i] == "/" and out and "/" in kinds:
            start = before(out, len(out))
            while start >= 2 and out[start - 1] in ("*", "%"):
                start = before(out, start - 1)
            end = after(t, i + 1)
            left, right = " ".join(out[start:]), " ".join(_arithmetic(t[i + 1 : end], decide, kinds))
            out[start:] = [decide("/", left, right, "")]
            i = end
            continue
        if t[i].upper() in kinds and t[i] != "/" and i + 1 < len(t) and t[i + 1] == "(":
            j = closing(t, i + 1)
            end = tail(t, j + 1)
            rest = t[j + 1 : end]
            if "EXCLUDE" not in (x.upper() for x in rest):
                inner = t[i + 2 : j]
                distinct = "DISTINCT" if inner and inner[0].upper() == "DISTINCT" else ""
                argument = " ".join(_arithmetic(inner[bool(distinct) :], decide, kinds))
                out.append(decide(t[i].upper(), argument, distinct, " ".join(_arithmetic(rest, decide, kinds))))
                i = end
                continue
        out.append(t[i])
        i += 1
    return out


def _key(*parts: str) -> str:
    return "tessera:" + hashlib.md5("\x1f".join(parts).encode()).hexdigest()


def integer_arithmetic(t: list[str], analyse: Callable[[str], DataFrame]) -> list[str]:
    """Divisions of integers that cut towards zero, AVG and SUM of integers that are integers of the column's type.

    What the operands are only Spark's analyser knows: the query is analysed once with a mark at each place that tells their types
    (nothing runs), and then written with `div` and casts where these are integers. Divisions come before and after the aggregates, as either may stand in
    the other.
    """
    from tessera.plans.frontend import tokens

    for kinds in (("/",), ("AVG", "SUM"), ("/",)):
        if any(x.upper() in kinds for x in t):
            t = [x for part in _decided(t, analyse, kinds) for x in (tokens(part) if " " in part else [part])]
    return t


def _decided(t: list[str], analyse: Callable[[str], DataFrame], kinds: tuple[str, ...]) -> list[str]:
    wanted = set()

    def plain(kind: str, a: str, b: str, rest: str) -> str:
        return f"({a} / {b})" if kind == "/" else f"{kind}({b} {a}) {rest}".strip()

    def probe(kind: str, a: str, b: str, rest: str) -> str:
        key = _key(kind, a, b)
        wanted.add(key)
        if kind == "/":
            return f"if('{key}' = concat(typeof({a}), ':', typeof({b})), NULL, {plain(kind, a, b, rest)})"
        return f"{kind}({b} if('{key}' = concat(typeof({a}), ':', ''), NULL, {a})) {rest}".strip()

    text = " ".join(_arithmetic(t, probe, kinds))
    types = _types(analyse(text), wanted)

    def chosen(kind: str, a: str, b: str, rest: str, known: str | None = None) -> str:
        of = types.get(_key(kind, *known) if known else "", [])
        if not of or not set(of) <= INTEGERS:
            return plain(kind, a, b, rest)
        if kind == "/":
            return f"CAST(({a} div {b}) AS {max(of, key=['tinyint', 'smallint', 'int', 'bigint'].index)})"
        if kind == "SUM":
            return f"CAST({plain(kind, a, b, rest)} AS {of[0]})"
        return f"CAST((SUM({b} {a}) {rest} div nullif(COUNT({b} {a}) {rest}, 0)) AS {of[0]})"

    # both runs see the operands in the same order; their keys are those of the marked text
    keys: list[tuple[str, str]] = []

    def note(kind: str, a: str, b: str, rest: str) -> str:
        keys.append((a, b))
        return probe(kind, a, b, rest)

    _arithmetic(t, note, kinds)
    order = iter(keys)
    return _arithmetic(t, lambda kind, a, b, rest: chosen(kind, a, b, rest, next(order)), kinds)


def _types(df: DataFrame, wanted: set[str]) -> dict[str, list[str]]:
    """Types of what the marks of an analysed query enclose."""
    found: dict[str, list[str]] = {}

    def items(seq) -> list:
        return [seq.apply(k) for k in range(seq.size())]

    def walk(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "EqualTo" and e.left().getClass().getSimpleName() == "Literal" and e.left().toString() in wanted:
            inside = [x for x in items(e.right().children()) if x.getClass().getSimpleName() == "TypeOf"]
            found.setdefault(e.left().toString(), [items(x.children())[0].dataType().simpleString() for x in inside])
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            plan(e.plan())
        for c in items(e.children()):
            walk(c)

    def plan(p) -> None:
        for e in items(p.expressions()):
            walk(e)
        for c in items(p.children()):
            plan(c)

    plan(df._jdf.queryExecution().analyzed())
    return found


# ---- frames with an exclusion


def excluded_frames(t: list[str]) -> list[str]:
    """f(x) OVER (.. ROWS BETWEEN a AND b EXCLUDE CURRENT ROW | GROUP | TIES) for SUM, COUNT, AVG, MIN and MAX.

    CURRENT ROW: the frame on either side of the row. GROUP and TIES over all rows up to the row, or of the partition: sums and counts less the peers'.
    Otherwise the frame's rows are held and the peers filtered out, so its length should be bounded.
    """
    from tessera.plans.frontend import tokens

    out: list[str] = []
    i = 0
    while i < len(t):
        if t[i].upper() == "OVER" and i + 1 < len(t) and t[i + 1] == "(":
            j = closing(t, i + 1)
            inside = t[i + 2 : j]
            words = [x.upper() for x in inside]
            if "EXCLUDE" in words:
                start = before(out, len(out))
                call = out[start:]
                del out[start:]
                out += tokens(_excluded(call, inside, words))
                i = j + 1
                continue
        out.append(t[i])
        i += 1
    return out


def _bound(words: list[str]) -> int | None:
    if words[0] == "UNBOUNDED":
        return None
    return 0 if words[0] == "CURRENT" else int(words[0]) * (-1 if words[1] == "PRECEDING" else 1)


def _excluded(call: list[str], inside: list[str], words: list[str]) -> str:
    f, value = call[0].upper(), " ".join(call[2:-1])
    if f not in ("SUM", "COUNT", "AVG", "MIN", "MAX") or call[1] != "(" or (value[:8].upper() == "DISTINCT"):
        raise NotImplementedError(f"EXCLUDE with {f}")
    value = "1" if value == "*" else value
    what = words[words.index("EXCLUDE") + 1]
    unit = next((k for k, x in enumerate(words) if x in ("ROWS", "RANGE")), len(words))
    head = inside[: min(unit, words.index("EXCLUDE"))]
    at = next((k for k in range(len(head) - 1) if head[k].upper() == "ORDER"), len(head))
    partition, order = head[2:at] if head[:1] and head[0].upper() == "PARTITION" else [], head[at + 2 :]
    by, sort = (f"PARTITION BY {' '.join(partition)}" if partition else ""), f"ORDER BY {' '.join(order)}"
    if what == "NO":
        return f"{f}({value}) OVER ({by} {' '.join(inside[at : words.index('EXCLUDE')])})"
    if unit == len(words) or words[unit] == "RANGE":
        rows, low, high = False, None, 0
        if unit < len(words) and words[unit + 1 : unit + 7] not in (["BETWEEN", "UNBOUNDED", "PRECEDING", "AND", "CURRENT", "ROW"], ["UNBOUNDED", "PRECEDING", "EXCLUDE", what]) and "FOLLOWING" not in words:
            raise NotImplementedError("EXCLUDE over a RANGE frame with an offset")
        if "FOLLOWING" in words[unit:]:
            low, high, rows = None, None, True
    else:
        rows = True
        frame = words[unit + 1 : words.index("EXCLUDE")]
        if frame[0] == "BETWEEN":
            low, high = _bound(frame[1:]), _bound(frame[frame.index("AND") + 1 :])
        else:
            low, high = _bound(frame), 0
    text = lambda x: "UNBOUNDED" if x is None else str(abs(x))

    def over(a, b) -> str:
        name = lambda x, end: "CURRENT ROW" if x == 0 else f"{text(x)} {end if x is None else 'PRECEDING' if x < 0 else 'FOLLOWING'}"
        return f"({by} {sort} ROWS BETWEEN {name(a, 'PRECEDING')} AND {name(b, 'FOLLOWING')})"

    own_in = (low is None or low <= 0) and (high is None or high >= 0)
    own = f"CASE WHEN {value} IS NOT NULL THEN 1 ELSE 0 END"
    peers = f"(PARTITION BY {', '.join(x for x in (' '.join(partition), ', '.join(_keys(order))) if x)})"
    whole = f"({by} {sort} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if high == 0 else f"({by})"
    if what == "CURRENT" and rows:
        frames = []
        if low is None or low < 0:
            frames.append(over(low, -1 if high is None or high > -1 else high))
        if high is None or high > 0:
            frames.append(over(1 if low is None or low < 1 else low, high))
        parts = {g: [f"{g}({value}) OVER {x}" for x in frames] for g in ("SUM", "COUNT", "MIN", "MAX")}
    elif what != "CURRENT" and f in ("SUM", "COUNT", "AVG") and low is None and high in (0, None):
        add = what == "TIES"
        less = {"SUM": f"coalesce(SUM({value}) OVER {whole}, 0) - coalesce(SUM({value}) OVER {peers}, 0)", "COUNT": f"COUNT({value}) OVER {whole} - COUNT({value}) OVER {peers}"}
        parts = {"SUM": [f"({less['SUM']})", *([f"coalesce({value}, 0)"] if add else [])], "COUNT": [f"({less['COUNT']})", *([own] if add else [])]}
    else:
        if not rows and what != "CURRENT":
            frame = whole
        elif not rows:
            raise NotImplementedError("EXCLUDE CURRENT ROW over a RANGE frame")
        else:
            frame = over(low, high)
        key = f"struct({', '.join(_keys(order))})"
        held = f"transform(filter(collect_list(struct({key} AS k, {value} AS v)) OVER {frame}, x -> NOT (x.k <=> {key})), x -> x.v)"
        known = f"filter({held}, v -> v IS NOT NULL)"
        extra = f"coalesce({value}, 0)"
        parts = {"SUM": [f"aggregate({known}, {value} * 0, (a, v) -> a + v)"], "COUNT": [f"CAST(size({known}) AS BIGINT)"], "MIN": [f"array_min({held})"], "MAX": [f"array_max({held})"]}
        parts["SUM"] = [f"coalesce(aggregate({known}, CAST(0 AS DECIMAL(38,6)), (a, v) -> CAST(a + v AS DECIMAL(38,6))), 0)"]
        if what == "TIES" and own_in:
            for g, x in (("SUM", extra), ("COUNT", own), ("MIN", value), ("MAX", value)):
                parts[g].append(x)
    count = " + ".join(parts["COUNT"]) or "0"
    total = " + ".join(f"coalesce({x}, 0)" for x in parts["SUM"]) or "NULL"
    if f == "COUNT":
        return f"({count})"
    if f in ("SUM", "AVG"):
        return f"(CASE WHEN ({count}) > 0 THEN " + (f"({total})" if f == "SUM" else f"(({total}) / ({count}))") + " END)"
    least = parts[f]
    if not least:
        return "NULL"
    return f"{'least' if f == 'MIN' else 'greatest'}({', '.join(least)})" if len(least) > 1 else f"({least[0]})"


def _keys(order: list[str]) -> list[str]:
    out = []
    for item in split(order):
        words = [x.upper() for x in item]
        end = next((k for k, x in enumerate(words) if x in ("ASC", "DESC", "NULLS")), len(item))
        out.append(" ".join(item[:end]))
    return out


# ---- collections and measures


def collections(t: list[str]) -> list[str]:
    """ARRAY(SELECT ..) and MULTISET(SELECT ..) as collected rows, IS [NOT] EMPTY as a size (unknown for null)."""
    out: list[str] = []
    i = 0
    while i < len(t):
        word = t[i].upper()
        if word in ("ARRAY", "MULTISET") and i + 2 < len(t) and t[i + 1] == "(" and up(t, i + 2) in ("SELECT", "WITH", "VALUES"):
            j = closing(t, i + 1)
            inner = collections(t[i + 2 : j])
            words, depth, end = [x.upper() for x in inner], 0, len(inner)
            for k, x in enumerate(words):
                depth += (x in ("(", "[")) - (x in (")", "]"))
                if depth == 0 and x == "FROM":
                    end = k
                    break
            n = len(split(inner[1:end])) if words[0] == "SELECT" else 1
            if inner[1:end] == ["*"]:
                raise NotImplementedError(f"{word}(SELECT *): name the columns")
            names = [f"__c{k}" for k in range(n)]
            value = "e.__c0" if n == 1 else "e"
            out += ["(", "SELECT", "transform", "(", f"collect_list(struct({', '.join(names)}))", ",", f"e -> {value}", ")", "FROM", "(", *inner, ")", "AS", f"__q({', '.join(names)})", ")"]
            i = j + 1
            continue
        if word == "IS" and (up(t, i + 1) == "EMPTY" or (up(t, i + 1) == "NOT" and up(t, i + 2) == "EMPTY")):
            start = before(out, len(out))
            left = out[start:]
            del out[start:]
            negated = up(t, i + 1) == "NOT"
            out += ["(", "CASE", "WHEN", *left, "IS", "NOT", "NULL", "THEN", "size", "(", *left, ")", "<>" if negated else "=", "0", "END", ")"]
            i += 3 if negated else 2
            continue
        out.append(t[i])
        i += 1
    return out


def measures(t: list[str], known: dict[str, list[str]]) -> list[str]:
    """SELECT .., f(x) AS MEASURE m, .. FROM s: the select list without m and with all of s, and AGGREGATE(m) as f(x) wherever it stands.

    known collects measures by name, so that those of a view serve the queries over it.
    """
    out: list[str] = []
    i = 0
    while i < len(t):
        if t[i].upper() == "SELECT":
            depth, end = 0, i + 1
            while end < len(t) and not (depth == 0 and (t[end].upper() == "FROM" or t[end] == ")")):
                depth += (t[end] in ("(", "[")) - (t[end] in (")", "]"))
                end += 1
            items = split(t[i + 1 : end])
            if any(len(x) > 3 and x[-2].upper() == "MEASURE" and x[-3].upper() == "AS" for x in items):
                kept = []
                for x in items:
                    if len(x) > 3 and x[-2].upper() == "MEASURE":
                        known[x[-1].strip("`").upper()] = x[:-3]
                    elif len(x) > 1 and x[-2:-1] != ["."]:
                        kept.append(x)  # more than a column of s
                out += ["SELECT", "*", *(y for x in kept for y in (",", *x))]
                i = end
                continue
        out.append(t[i])
        i += 1
    t, out, i = out, [], 0
    while i < len(t):  # a measure is often used before the sub-query that has it
        if t[i].upper() == "AGGREGATE" and i + 3 < len(t) and t[i + 1] == "(" and t[i + 3] == ")" and t[i + 2].strip("`").upper() in known:
            out += known[t[i + 2].strip("`").upper()]
            i += 4
            continue
        out.append(t[i])
        i += 1
    return out


# ---- EXISTS in EXISTS


def _body(t: list[str]) -> tuple[list[str], list[str]] | None:
    """FROM and WHERE of a plain SELECT; None where it has other clauses."""
    depth, places = 0, {}
    for i, x in enumerate(t):
        depth += (x in ("(", "[")) - (x in (")", "]"))
        word = x.upper()
        if depth == 0 and word in ("FROM", "WHERE"):
            places.setdefault(word, i)
        elif depth == 0 and (word in ("GROUP", "HAVING", "UNION", "INTERSECT", "EXCEPT", "LIMIT", "OFFSET", "FETCH", "LATERAL") or (word == "SELECT" and i)):
            return None
    if up(t, 0) != "SELECT" or "FROM" not in places or "WHERE" not in places:
        return None
    return t[places["FROM"] + 1 : places["WHERE"]], t[places["WHERE"] + 1 :]


def conjuncts(t: list[str]) -> list[list[str]]:
    """Parts between ANDs outside brackets, BETWEEN and CASE."""
    out: list[list[str]] = [[]]
    depth = between = case = 0
    for x in t:
        depth += (x in ("(", "[")) - (x in (")", "]"))
        word = x.upper()
        case += (word == "CASE") - (word == "END")
        if depth == 0 and word == "BETWEEN":
            between += 1
        if depth == 0 and case == 0 and word == "AND":
            if between:
                between -= 1
            else:
                out.append([])
                continue
        out[-1].append(x)
    return out


def flat_exists(t: list[str]) -> list[str]:
    """EXISTS (.. FROM a WHERE p AND EXISTS (.. FROM b WHERE q)) as EXISTS (.. FROM a, b WHERE p AND q), which has no reference over two levels."""
    out: list[str] = []
    i = 0
    while i < len(t):
        if t[i].upper() == "EXISTS" and i + 1 < len(t) and t[i + 1] == "(":
            j = closing(t, i + 1)
            inner = flat_exists(t[i + 2 : j])
            own = _body(inner)
            if own is not None:
                source, tests = own[0], []
                for part in conjuncts(own[1]):
                    found = _body(part[2:-1]) if up(part, 0) == "EXISTS" and part[1:2] == ["("] and closing(part, 1) == len(part) - 1 else None
                    if found is None:
                        tests.append(part)
                    else:
                        source, tests = [*source, ",", *found[0]], [*tests, ["(", *found[1], ")"]]
                inner = ["SELECT", "1", "FROM", *source, "WHERE", *(x for k, part in enumerate(tests) for x in ((["AND"] if k else []) + part))]
            out += ["EXISTS", "(", *inner, ")"]
            i = j + 1
            continue
        out.append(t[i])
        i += 1
    return out
