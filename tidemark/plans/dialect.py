"""Label SQL written for DuckDB, made fit for Spark's parser.

Four things differ: time steps are rendered as plain literals, correlated subqueries in FROM need ``LATERAL``, stacked
``A JOIN B JOIN C ON x ON y`` needs parentheses, and naive timestamp literals are ``TIMESTAMP_NTZ``.  Hints say which side
of an outer join to broadcast, and which tables not to.  Anything else is left to Spark, whose error is passed on.  All of it is decided on tokens, not by trying.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from datetime import timedelta

from tidemark.functions.columns import interval_text

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|\w+|\s+|.", re.S)
_JOIN_WORDS = {"left", "right", "full", "inner", "outer", "cross", "semi", "anti"}
_AFTER_TABLE = {"join", "on", "using", "where", "group", "having", "order", "limit", "window", "union", "except", "intersect", "lateral", "natural"}


def _tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _word(token: str) -> str:
    return token.lower() if re.fullmatch(r"\w+", token) else token


def render_step(sql: str, step: timedelta) -> str:
    """``{timedelta}`` by plain replacement, so other braces in the text are safe."""
    return sql.replace("{timedelta}", interval_text(step))


def ntz_literals(sql: str) -> str:
    out = _tokens(sql)
    for i, token in enumerate(out):
        if token.lower() == "timestamp":
            after = next((t for t in out[i + 1 :] if not t.isspace()), "")
            if after.startswith("'"):
                out[i] = "TIMESTAMP_NTZ"
    return "".join(out)


def nest_stacked_joins(sql: str) -> str:
    """Put parentheses around the inner of two joins whose conditions stand one after the other."""
    tokens = _tokens(sql)
    insert: dict[int, list[str]] = {}
    levels: list[list[dict]] = [[]]
    i = 0
    while i < len(tokens):
        word = _word(tokens[i])
        if word == "(":
            levels.append([])
        elif word == ")":
            for j in levels.pop() if len(levels) > 1 else []:
                if j.get("open") and not j.get("done"):
                    insert.setdefault(i, []).append(")")
        elif word == "join":
            cross = any(_word(t) == "cross" for t in _back(tokens, i, 3))
            if not cross:
                levels[-1].append({"after": i + 1})
        elif word == "on" and levels[-1]:
            waiting = [j for j in levels[-1] if "on" not in j]
            closing = [j for j in levels[-1] if "on" in j and j.get("inner") and not j.get("done")]
            if closing:
                insert.setdefault(i, []).append(")")
                closing[-1]["done"] = True
                waiting = [j for j in levels[-1] if "on" not in j]
            if waiting:
                waiting[-1]["on"] = i
                if len(waiting) > 1:
                    waiting[-1]["inner"] = True
                    insert.setdefault(waiting[-2]["after"], []).append(" (")
        elif word in {"where", "group", "select", "union", "order", "having"}:
            levels[-1] = []
        i += 1
    out = []
    for i, token in enumerate(tokens):
        out += insert.get(i, [])
        out.append(token)
    return "".join(out)


def _back(tokens: list[str], i: int, n: int) -> list[str]:
    return [t for t in tokens[max(0, i - 2 * n) : i] if not t.isspace()][-n:]


def add_lateral(sql: str) -> str:
    """``LATERAL`` where DuckDB has it unsaid: before a subquery that follows a comma in a FROM list, and before a joined one
    that names an alias of a relation to its left."""
    tokens = _tokens(sql)
    out: list[str] = []
    in_from, names = [False], [set()]
    for i, token in enumerate(tokens):
        word = _word(token)
        if word == "(":
            ahead = next((_word(t) for t in tokens[i + 1 :] if not t.isspace()), "")
            back = [_word(t) for t in _back(tokens, i, 1)]
            if ahead in {"select", "with"} and back:
                joined = back[0] == "join" and names[-1] & _qualifiers(tokens, i)
                if (back[0] == "," and in_from[-1]) or joined:
                    out.append("LATERAL ")
            in_from.append(False)
            names.append(set())
        elif word == ")":
            if len(in_from) > 1:
                in_from.pop()
                names.pop()
        elif word == "from":
            in_from[-1] = True
        elif word in {"where", "group", "having", "order", "limit", "union", "select", "on"}:
            in_from[-1] = word == "on" and in_from[-1]
            if word in {"select", "union"}:
                names[-1] = set()
        elif in_from[-1] and re.fullmatch(r"[a-z_]\w*", word) and word not in _JOIN_WORDS | {"join", "as", "lateral", "and", "or", "not"}:
            names[-1].add(word)
        out.append(token)
    return "".join(out)


def _qualifiers(tokens: list[str], start: int) -> set[str]:
    """Words before a dot in the parentheses that open at ``start``, without those named in its own FROM."""
    depth, found, own = 0, set(), set()
    for k in range(start, len(tokens)):
        depth += (tokens[k] == "(") - (tokens[k] == ")")
        if not depth:
            break
        word, after = _word(tokens[k]), tokens[k + 1] if k + 1 < len(tokens) else ""
        if after == ".":
            found.add(word)
        elif re.fullmatch(r"[a-z_]\w*", word) and _back(tokens, k, 1) and _word(_back(tokens, k, 1)[0]) not in {"select", "where", "and", "or", "by", "on", "."}:
            own.add(word)
    return found - own


def broadcast_kept(sql: str, table: str) -> str:
    """A broadcast hint in each SELECT where ``table``, alone, is the side that an outer join keeps.

    Spark broadcasts the other side of a join on a range, whatever its size, if the kept one is over the threshold or the
    threshold is off.  Other joins get no hint: they take the smaller side, and a hint would hold them in their written order.
    """

    def kept(before: list[str], behind: list[str]) -> bool:
        left = before[-1] in {"from", ",", "("} and " ".join(behind[:2]) in {"left join", "left outer"}
        return left or " ".join(before[-3:]).endswith(("right join", "right outer join"))

    return _hinted(sql, "BROADCAST", [table], kept)


def merge_joined(sql: str, tables: Collection[str]) -> str:
    """A merge hint in each SELECT for those of ``tables`` that it reads, so that Spark does not broadcast them for an equality."""
    return _hinted(sql, "MERGE", tables, lambda before, behind: before[-1] in {"from", "join", ",", "("} and behind[:1] != ["."])


def _hinted(sql: str, hint: str, tables: Collection[str], fits: Callable[[list[str], list[str]], bool]) -> str:
    """``hint`` in each SELECT for ``tables``, by their aliases, where the words before a table and behind its alias fit."""
    tokens = _tokens(sql)
    places = [i for i, t in enumerate(tokens) if not t.isspace() and not t.startswith("--")]
    words = [_word(tokens[i]) for i in places]
    wanted = {t.lower() for t in tables}
    insert: dict[int, dict[str, None]] = {}
    selects: list[int | None] = [None]
    for k, word in enumerate(words):
        if word == "(":
            selects.append(selects[-1])
        elif word == ")" and len(selects) > 1:
            selects.pop()
        elif word == "select":
            selects[-1] = places[k]
        elif word in wanted and selects[-1] is not None:
            ahead = (words[k + 1 :] + [""])[0]
            aliased = bool(re.fullmatch(r"[a-z_]\w*", ahead)) and ahead not in _JOIN_WORDS | _AFTER_TABLE
            at = k + aliased + (ahead == "as")
            if fits(words[:k], words[at + 1 :]):
                insert.setdefault(selects[-1], {})[tokens[places[at]]] = None
    return "".join(t + "".join(f" /*+ {hint}({n}) */" for n in insert.get(i, ())) for i, t in enumerate(tokens))


def with_tables(sql: str, places: dict[str, str]) -> str:
    """The query with each table name bound to the view that holds it, by common table expressions in front."""
    tokens = _tokens(sql)
    first = next((i for i, t in enumerate(tokens) if not t.isspace() and not t.startswith("--")), 0)
    bound = ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in places.items())
    if _word(tokens[first]) != "with":
        return f"WITH {bound} {sql}"
    rest = "".join(tokens[first + 1 :]).lstrip()
    if rest.lower().startswith("recursive"):
        return f"WITH RECURSIVE {bound}, {rest[9:].lstrip()}"
    return f"WITH {bound}, {rest}"


def to_spark(sql: str, step: timedelta) -> str:
    return add_lateral(nest_stacked_joins(ntz_literals(render_step(sql, step))))
