"""Standard SQL that Spark's parser refuses or reads differently, rewritten token by token (strings and comments are left alone)."""

from __future__ import annotations

import re

from tessera.plans import rewrites

_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<other><=>|->|<=|>=|<>|!=|\|\||.)""", re.S)
_END_OF_ORDER = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "MINUS", ";"}


def tokens(sql: str) -> list[str]:
    """Words, strings and signs in order; white space and comments are dropped, and "names" become `names`."""
    out = []
    for m in _TOKEN.finditer(sql):
        if m.lastgroup == "space":
            continue
        t = m.group()
        out.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`" if m.lastgroup == "quoted" and t[0] == '"' else t)
    return out


def _closing(t: list[str], i: int) -> int:
    """Place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] in "([") - (t[j] in ")]") if t[j] in ("(", ")", "[", "]") else 0
        if depth == 0:
            return j
    raise ValueError("brackets don't match")


def _split(t: list[str]) -> list[list[str]]:
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


def _is(t: list[str], i: int, *words: str) -> bool:
    return [x.upper() for x in t[i : i + len(words)]] == list(words)


#: Times of the statement without a zone, with a precision of so many digits of a second.
_NOW = {"LOCALTIMESTAMP": "localtimestamp()", "LOCALTIME": "current_time({digits})", "CURRENT_TIME": "current_time({digits})"}


def _cut_to(digits: int) -> str:
    return f"CAST(date_format(localtimestamp(), 'yyyy-MM-dd HH:mm:ss{'.' + 'S' * digits if digits else ''}') AS TIMESTAMP_NTZ)"


def _literals(t: list[str]) -> list[str]:
    """ARRAY[..] and MULTISET[..] as array(..), names of functions as Spark has them."""
    out, i = [], 0
    while i < len(t):
        if t[i].upper() in ("ARRAY", "MULTISET") and i + 1 < len(t) and t[i + 1] == "[":
            j = _closing(t, i + 1)
            out += ["array", "(", *_literals(t[i + 2 : j]), ")"]
            i = j + 1
            continue
        if t[i].upper() == "ROW" and i + 1 < len(t) and t[i + 1] == "(":
            out.append("struct")
        elif t[i].upper() in _NOW:
            name, digits = t[i].upper(), None
            if i + 1 < len(t) and t[i + 1] == "(":
                j = _closing(t, i + 1)
                digits, i = (t[i + 2 : j] or [None])[0], j
            out.append(_cut_to(int(digits)) if digits and name == "LOCALTIMESTAMP" else _NOW[name].format(digits=digits or 6))
        else:
            out.append(t[i])
        i += 1
    return out


def _json(t: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(t):
        name = t[i].upper()
        if name in ("JSON_VALUE", "JSON_QUERY", "JSON_EXISTS") and i + 1 < len(t) and t[i + 1] == "(":
            j = _closing(t, i + 1)
            doc, path = _split(t[i + 2 : j])
            where = re.sub(r"^'(lax|strict) ", "'", path[0])
            at = ["try_variant_get", "(", "try_parse_json", "(", *_json(doc), ")", ",", where, ",", "'variant'", ")"]
            if name == "JSON_EXISTS":
                out += ["(", *at, "IS", "NOT", "NULL", ")"]
            else:  # by what the value is, not by how its text begins
                test = ["schema_of_variant", "(", *at, ")", *(["NOT"] if name == "JSON_VALUE" else []), "RLIKE", "'^(OBJECT|ARRAY)'"]
                out += ["(", "CASE", "WHEN", *test, "THEN", "get_json_object", "(", *_json(doc), ",", where, ")", "END", ")"]
            i = j + 1
            continue
        if name == "JSON_ARRAYAGG" and i + 1 < len(t) and t[i + 1] == "(":
            j = _closing(t, i + 1)
            inner = t[i + 2 : j]
            order = next((k for k in range(len(inner) - 1) if _is(inner, k, "ORDER", "BY")), len(inner))
            value, keys = inner[:order], inner[order + 2 :] or inner[:order]
            out += ["to_json", "(", "transform", "(", "array_sort", "(", "collect_list", "(", "CASE", "WHEN", *value, "IS", "NOT", "NULL", "THEN", "struct", "(", "struct", "(", *keys, ")", ",", *value, "AS", "v", ")", "END", ")", ")", ",", "e -> e.v", ")", ")"]
            i = j + 1
            continue
        out.append(t[i])
        i += 1
    return out


def _interval(t: list[str]) -> str:
    """INTERVAL '5' MINUTE as '5 minute'."""
    if len(t) != 3 or t[0].upper() != "INTERVAL":
        raise ValueError(f"not an interval: {' '.join(t)}")
    return f"'{t[1][1:-1]} {t[2].lower()}'"


_UNSIGNED = {"TINYINT": ("SMALLINT", 8), "SMALLINT": ("INT", 16), "INTEGER": ("BIGINT", 32), "INT": ("BIGINT", 32), "BIGINT": ("DECIMAL(20,0)", 64)}
_RENAMED = {"FLOAT": "DOUBLE", "VARBINARY": "BINARY", "BINARY": "BINARY", "TIMESTAMP": "TIMESTAMP_NTZ", "VARCHAR": "STRING"}


def _cast(value: list[str], kind: list[str]) -> list[str]:
    """CHAR(n) is blank-padded, VARCHAR(n) cut, FLOAT a double, TIMESTAMP without a zone, and unsigned integers are the next wider type in range."""
    name = kind[0].upper()
    text = ["CAST", "(", *value, "AS", "STRING", ")"]
    if name in ("CHAR", "CHARACTER") and len(kind) > 1 and kind[1] == "(":
        return ["rpad", "(", *text, ",", kind[2], ",", "' '", ")"]
    if name == "VARCHAR" and len(kind) > 1:
        return ["left", "(", *text, ",", kind[2], ")"]
    if len(kind) > 1 and kind[-1].upper() == "UNSIGNED" and name in _UNSIGNED:
        wide, bits = _UNSIGNED[name]
        whole = ["CAST", "(", *value, "AS", "DECIMAL(38,0)", ")"]
        return ["CASE", "WHEN", *whole, "BETWEEN", "0", "AND", str((1 << bits) - 1), "THEN", "CAST", "(", *value, "AS", wide, ")", "WHEN", *whole, "IS", "NOT", "NULL", "THEN", "raise_error", "(", f"'out of range for {bits} unsigned bits'", ")", "END"]
    if name in _RENAMED and "ZONE" not in (x.upper() for x in kind):
        kind = [_RENAMED[name]]
    return ["CAST", "(", *value, "AS", *kind, ")"]


def _casts(t: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(t):
        if t[i].upper() == "CAST" and i + 1 < len(t) and t[i + 1] == "(":
            j, depth = _closing(t, i + 1), 0
            for k in range(i + 2, j):
                depth += (t[k] == "(") - (t[k] == ")")
                if depth == 0 and t[k].upper() == "AS":
                    break
            out += _cast(_casts(t[i + 2 : k]), t[k + 1 : j])
            i = j + 1
            continue
        out.append(t[i])
        i += 1
    return out


def _window_tables(t: list[str]) -> list[str]:
    """TABLE(TUMBLE(TABLE x, DESCRIPTOR(c), ...)), HOP and SESSION as sub-queries."""
    out, i = [], 0
    while i < len(t):
        if _is(t, i, "TABLE", "(") and i + 3 < len(t) and t[i + 2].upper() in ("TUMBLE", "HOP", "SESSION") and t[i + 3] == "(":
            kind, end, outer = t[i + 2].upper(), _closing(t, i + 3), _closing(t, i + 1)
            args = _split(t[i + 4 : end])
            source = _window_tables(args[0][1:])
            from_ = source if source[0] == "(" else source
            describe = lambda a: a[2:-1]
            time = " ".join(describe(args[1]))
            if kind == "SESSION":
                keys, gap = ", ".join(" ".join(k) for k in _split(describe(args[2]))), "INTERVAL " + _interval(args[3])
                text = (
                    f"(SELECT * EXCEPT (__new, __s), min({time}) OVER (PARTITION BY {keys}, __s) AS window_start, max({time}) OVER (PARTITION BY {keys}, __s) + {gap} AS window_end "
                    f"FROM (SELECT *, sum(__new) OVER (PARTITION BY {keys} ORDER BY {time} ROWS UNBOUNDED PRECEDING) AS __s "
                    f"FROM (SELECT *, CASE WHEN {time} < lag({time}) OVER (PARTITION BY {keys} ORDER BY {time}) + {gap} THEN 0 ELSE 1 END AS __new FROM {' '.join(from_)} WHERE {time} IS NOT NULL)))"
                )
            else:
                spans = [_interval(a) for a in args[2:]]
                if kind == "HOP":
                    spans[0], spans[1] = spans[1], spans[0]
                elif len(spans) == 2:
                    spans.insert(1, spans[0])
                text = f"(SELECT * EXCEPT (__w), __w.start AS window_start, __w.end AS window_end FROM (SELECT *, window({time}, {', '.join(spans)}) AS __w FROM {' '.join(from_)}))"
            out.append(text)
            i = outer + 1
            continue
        out.append(t[i])
        i += 1
    return out


def _unnest(t: list[str]) -> list[str]:
    """UNNEST(x) [WITH ORDINALITY] [AS] a(c, ...) as explode or posexplode, lateral where something stands before it."""
    out, i = [], 0
    while i < len(t):
        if t[i].upper() == "UNNEST" and i + 1 < len(t) and t[i + 1] == "(":
            j = _closing(t, i + 1)
            value = " ".join(_unnest(t[i + 2 : j]))
            i = j + 1
            counted = _is(t, i, "WITH", "ORDINALITY")
            i += 2 * counted
            i += _is(t, i, "AS")
            alias, columns = t[i] if i < len(t) else "u", None
            if i < len(t) and (re.match(r"[A-Za-z_`]", t[i])) and t[i].upper() not in ("WHERE", "ORDER", "GROUP", "ON", "JOIN", "LIMIT", "CROSS", "LEFT"):
                i += 1
                if i < len(t) and t[i] == "(":
                    j = _closing(t, i)
                    columns = [" ".join(c) for c in _split(t[i + 1 : j])]
                    i = j + 1
            else:
                alias = "u"
            columns = columns or (["col", "ordinality"] if counted else ["col"])
            lateral = bool(out) and out[-1].upper() in (",", "JOIN")
            if counted:
                *names, n = columns
                text = f"(SELECT {', '.join(f'c{k} AS {c}' for k, c in enumerate(names))}, p + 1 AS {n} FROM (SELECT posexplode({value}) AS (p, c0))) AS {alias}"
            else:
                text = f"(SELECT explode({value}) AS {columns[0]}) AS {alias}" if len(columns) == 1 else f"(SELECT inline({value}) AS ({', '.join(columns)})) AS {alias}"
            out += (["LATERAL"] if lateral else []) + [text]
            continue
        out.append(t[i])
        i += 1
    return out


def _asof(t: list[str]) -> list[str]:
    """l ASOF JOIN r b MATCH_CONDITION b.x <= l.y ON k: the nearest row in a lateral sub-query, of equally near ones always the same. It joins on the
    key first; the session uses asof_join where it can."""
    out, i = [], 0
    while i < len(t):
        if _is(t, i, "ASOF", "JOIN"):
            left = bool(out) and out[-1].upper() == "LEFT"
            if left:
                out.pop()
            j = _closing(t, i + 2) if t[i + 2] == "(" else i + 2
            source = _asof(t[i + 2 : j + 1])
            alias = t[j + 1] if not _is(t, j + 1, "MATCH_CONDITION") else t[j]
            k = j + 1 + (not _is(t, j + 1, "MATCH_CONDITION"))
            on = next(m for m in range(k, len(t)) if t[m].upper() == "ON")
            match = t[k + 1 : on]
            if match and match[0] == "(":
                match = match[1:-1]
            end = next((m for m in range(on, len(t)) if t[m].upper() in ("WHERE", "ORDER", "GROUP", "LIMIT", "HAVING", "UNION", ")", "FETCH", "OFFSET", ";")), len(t))
            sign = next(m for m, x in enumerate(match) if x in ("<", "<=", ">", ">="))
            a, b = match[:sign], match[sign + 1 :]
            own, op = (a, match[sign]) if a[0].strip("`").upper() == alias.strip("`").upper() else (b, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[match[sign]])
            order = "DESC" if op[0] == "<" else "ASC"
            out += ["LEFT" if left else "INNER", "JOIN", "LATERAL", "(", "SELECT", "*", "EXCEPT", "(", "__tie", ")", "FROM", "(", "SELECT", "*", ",", "xxhash64(*)", "AS", "__tie", "FROM", *source, ")", alias, "WHERE", *match, "AND", *t[on + 1 : end], "ORDER", "BY", *own, order, ",", "__tie", "LIMIT", "1", ")", alias, "ON", "TRUE"]
            i = end
            continue
        out.append(t[i])
        i += 1
    return out


def _orders(t: list[str], nulls_high: bool) -> list[str]:
    """Nulls last ascending and first descending, and an order for row numbers that have none."""
    out, i = [], 0
    while i < len(t):
        if _is(t, i, "ROW_NUMBER", "(", ")", "OVER", "("):
            j = _closing(t, i + 4)
            inside = t[i + 5 : j]
            if "ORDER" not in (x.upper() for x in inside):
                inside = [*inside, "ORDER", "BY", "1", "NULLS", "LAST"]
            out += [*t[i : i + 5], *_orders(inside, nulls_high), ")"]
            i = j + 1
            continue
        if _is(t, i, "ORDER", "BY") and nulls_high:
            j, depth = i + 2, 0
            while j < len(t):
                depth += (t[j] == "(") - (t[j] == ")")
                if depth < 0 or (depth == 0 and t[j].upper() in _END_OF_ORDER):
                    break
                j += 1
            items = []
            for item in _split(t[i + 2 : j]):
                words = [x.upper() for x in item]
                item = _orders(item, nulls_high)
                items.append(item if "NULLS" in words else [*item, "NULLS", "FIRST" if words[-1] == "DESC" else "LAST"])
            out += ["ORDER", "BY", *(x for k, item in enumerate(items) for x in ([","] if k else []) + item)]
            i = j
            continue
        out.append(t[i])
        i += 1
    return out


def _pages(t: list[str]) -> list[str]:
    """OFFSET n ROWS FETCH NEXT m ROWS ONLY as LIMIT m OFFSET n. An offset belongs to the query of its own brackets, and to one FETCH."""
    out: list[str] = []
    offsets: list[str | None] = [None]
    i = 0
    while i < len(t):
        if t[i] == "(":
            offsets.append(None)
        elif t[i] == ")" and len(offsets) > 1:
            offsets.pop()
        if t[i].upper() == "OFFSET" and i + 2 < len(t) and t[i + 2].upper() in ("ROW", "ROWS"):
            offset = t[i + 1]
            i += 3
            if _is(t, i, "FETCH"):
                offsets[-1] = offset
            else:
                out += ["OFFSET", offset]
            continue
        if t[i].upper() == "FETCH" and i + 4 < len(t) and t[i + 1].upper() in ("FIRST", "NEXT"):
            out += ["LIMIT", t[i + 2], *(["OFFSET", offsets[-1]] if offsets[-1] is not None else [])]
            offsets[-1] = None
            i += 5
            continue
        out.append(t[i])
        i += 1
    return out


def translate(sql: str | list[str], nulls_high: bool = True, measures: dict[str, list[str]] | None = None) -> str:
    """sql (or its tokens) for Spark. What changes more than the text at hand (MATCH_RECOGNIZE, WITH RECURSIVE .. UNION, EXCLUDE) the session does before."""
    t = tokens(sql) if isinstance(sql, str) else sql
    for word, operator in (("MATCH_RECOGNIZE", "match.match_sequence"), ("EXCLUDE", "windows.exclude_window")):
        if word in (x.upper() for x in t):
            raise NotImplementedError(f"{word} as text alone: use a session, or tessera.operators.{operator}")
    t = rewrites.measures(t, {} if measures is None else measures)
    for step in (rewrites.collections, _literals, rewrites.projected_in, _casts, _json, _window_tables, _unnest, _asof, _pages):
        t = step(t)
    t = _orders(t, nulls_high)
    return " ".join(t).replace(" . ", ".").replace(" .*", ".*")
