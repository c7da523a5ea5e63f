"""Secret scans over a trigram index: Boolean trigram queries are derived from each rule's expression, postings
are intersected, and only candidates meet the expression itself.

Built-in functions only, and nothing is shuffled: the index is partitioned by document, as search engines keep it. One pass over
the lower-cased text lists which of the rules' trigrams it holds; a rule's lists are intersected where the text already is, so
that verifying needs no join back to the texts. ``postings`` gives the same lists as (trigram, id) rows, to be stored and
queried again. A rule without mandatory trigrams scans every text.

Defined results: a null text is empty and has no spans; ids may be null or repeat; an empty table gives an empty result;
columns other than the id and the text are ignored by ``scan`` and kept as they are by ``redact``, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.functions.text import let, offsets, running
from quillspan.llm.common import unused


@dataclass(frozen=True)
class Rule:
    """``regex`` in the common part of Java, RE2 and Python; a match counts if ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of 24 or more is what [0-9a-f]+ finds there, as runs are maximal
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._!$%^&*+=-]{1,64}@"),
)
#: Most strings that a part of an expression may stand for and still be followed exactly.
MOST = 40
#: A query: of every clause the text holds all trigrams of at least one alternative. An empty query is true of any text.
Query = frozenset


def _all_of(strings: set[str]) -> Query:
    """What holds of a text with one of ``strings`` in it."""
    ways = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    return Query([_least(ways)]) if all(ways) else Query()


def _least(ways) -> frozenset:
    """Without the ways that ask for more than another way does."""
    return frozenset(w for w in ways if not any(x < w for x in ways))


def _either(queries: list[Query]) -> Query:
    """One clause that holds if any of ``queries`` does; only what each of them surely needs is kept."""
    ways = [frozenset().union(*(next(iter(c)) for c in q if len(c) == 1)) for q in queries]
    return Query([_least(set(ways))]) if all(ways) else Query()


class _Part:
    """What a part of an expression can match: exactly ``exact`` strings (or None), and what it needs besides."""

    def __init__(self, exact: set[str] | None, needs: Query = Query()):
        self.exact, self.needs = exact, needs

    def query(self) -> Query:
        return self.needs | (_all_of(self.exact) if self.exact is not None else Query())


def _join(parts: list[_Part]) -> _Part:
    run, needs, whole = {""}, Query(), True
    for p in parts:
        needs |= p.needs
        if p.exact is not None and len(run) * len(p.exact) <= MOST:
            run = {a + b for a in run for b in p.exact}
            continue
        needs |= _all_of(run)
        run, whole = (p.exact if p.exact is not None else {""}), False
    return _Part(run, needs) if whole else _Part(None, needs | _all_of(run))


def _parts(tree) -> _Part:
    out = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append(_Part({chr(arg).lower()}))
        elif op is C.IN:
            listed = [chr(v).lower() for o, v in arg if o is C.LITERAL] if all(o is C.LITERAL for o, _ in arg) else None
            out.append(_Part(set(listed) if listed else None))
        elif op is C.SUBPATTERN:
            out.append(_parts(arg[-1]))
        elif op is C.BRANCH:
            found = [_parts(x) for x in arg[1]]
            if all(x.exact is not None for x in found) and len(got := set().union(*(x.exact for x in found))) <= MOST:
                out.append(_Part(got))
            else:
                out.append(_Part(None, _either([x.query() for x in found])))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            one = _parts(sub)
            if (low, high) == (0, 1) and one.exact is not None:
                out.append(_Part(one.exact | {""}))
            elif low == 0:
                out.append(_Part(None))
            else:
                steps = [one] * min(int(low), 3)
                out.append(_join(steps) if low == high and low <= 3 else _join([*steps, _Part(None)]))
        elif op is C.AT:
            continue
        else:
            out.append(_Part(None))
    return _join(out)


def trigram_query(regex: str) -> Query:
    """The trigrams that a lower-cased text must hold for ``regex`` to match anywhere in it."""
    return _parts(_parser.parse(regex)).query()


class TrigramIndex:
    """The trigrams of a set of rules, and the tests over their postings."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = {r.kind: trigram_query(r.regex) for r in rules}
        self.grams = sorted({g for q in self.queries.values() for clause in q for way in clause for g in way})

    def pattern(self) -> str:
        """An expression that matches nothing where one of the trigrams begins, and captures it."""
        first = "".join(sorted({f"\\x{{{ord(g[0]):x}}}" for g in self.grams}))
        return f"(?=[{first}])(?=({_tree(self.grams)}))"

    def trigrams(self, text: Column) -> Column:
        """Which of the trigrams the lower-cased ``text`` holds, each once."""
        return F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern()), F.lit(1))) if self.grams else F.array().cast("array<string>")

    def candidate(self, kind: str, held: Column) -> Column:
        """Whether a text that holds the trigrams ``held`` satisfies the rule's query."""
        clauses = []
        for clause in sorted(self.queries[kind], key=lambda c: sorted(map(sorted, c))):
            clauses.append(reduce(or_, [F.size(F.array_except(F.array(*map(F.lit, sorted(way))), held)) == 0 for way in sorted(clause, key=sorted)]))
        return reduce(and_, clauses, F.lit(True))


def _tree(words: list[str]) -> str:
    """An expression for ``words``, those with the same beginning together."""
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[0], []).append(w[1:])
    return "|".join(f"\\x{{{ord(c):x}}}" + (f"(?:{_tree(rest)})" if rest[0] else "") for c, rest in ends.items())


def postings(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as rows (trigram, id), to be stored by trigram."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), F.explode(TrigramIndex(rules).trigrams(low)).alias("trigram"))


def _spans(text: Column, matches: Column, rule: Rule, rank: int) -> Column:
    """Spans of all matches: what lies between them comes from splitting by the same expression."""
    hits = offsets(F.split(text, rule.regex, -1), matches)
    value = lambda h: F.regexp_extract(h["tok"], rule.regex, rule.group) if rule.group else h["tok"]
    kept = F.filter(hits, lambda h: F.length(value(h)) >= rule.least) if rule.least else hits
    return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end")))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one array of (start, rank, end) per rule in ``{prefix}{kind}``, and the text in ``{prefix}text``; and the prefix."""
    prefix = unused(docs, "_s_")
    index, text = TrigramIndex(rules), F.col(f"{prefix}text")
    df = docs.withColumn(f"{prefix}text", F.coalesce(docs[text_col].cast("string"), F.lit("")))
    df = df.withColumn(f"{prefix}held", index.trigrams(F.lower(text)))
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{prefix}m_{r.kind}": F.when(index.candidate(r.kind, F.col(f"{prefix}held")), F.regexp_extract_all(text, F.lit(r.regex), F.lit(0))).otherwise(none) for r in rules})
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    df = df.withColumns({f"{prefix}{r.kind}": F.when(F.size(f"{prefix}m_{r.kind}") > 0, _spans(text, F.col(f"{prefix}m_{r.kind}"), r, k)).otherwise(empty) for k, r in enumerate(rules)})
    return df.drop(*(f"{prefix}m_{r.kind}" for r in rules), f"{prefix}held"), prefix


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans."""
    rules = BASE + tuple(more)
    df, prefix = with_spans(docs.select(F.col(id_col), F.col(text_col).alias("text")), rules)
    cols = lambda rs: F.concat(*(F.col(f"{prefix}{r.kind}") for r in rs))
    return df.select(
        id_col,
        *(F.size(f"{prefix}{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_listed(cols(BASE), rules), 256).alias("base_sha256"),
        _listed(cols(rules), rules).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans by one. Other columns stay as they are."""
    rules = BASE + MORE
    df, prefix = with_spans(docs, rules, text_col)
    text, spans = F.col(f"{prefix}text"), F.array_sort(F.concat(*(F.col(f"{prefix}{r.kind}") for r in rules)))

    def cut(found: Column) -> Column:
        # a span that begins where all before it have ended opens a gap before it, from the farthest of their ends
        open_ = F.filter(F.zip_with(found, running(F.transform(found, lambda s: s["end"]), F.greatest), lambda s, r: F.struct(r.alias("from"), s["start"].alias("to"))), lambda g: g["to"] >= g["from"])
        gaps = F.transform(open_, lambda g: F.substring(text, g["from"] + 1, g["to"] - g["from"]))
        return F.concat(F.array_join(gaps, mark), F.lit(mark), F.substring(text, F.array_max(F.transform(found, lambda s: s["end"])) + 1, F.length(text)))

    new = F.when(F.size(spans) > 0, let(spans, cut)).otherwise(docs[text_col])
    return df.withColumn(text_col, new).select(*(F.col(f"`{c}`") for c in docs.columns))


def _sql() -> str:
    def one(rank: int, r: Rule) -> str:
        p = r.regex.replace("'", "''")
        keep = f"length(regexp_extract(x.m, '{p}', {r.group})) >= {r.least}" if r.group else f"length(x.m) >= {r.least}"
        return f"""
  list_transform(list_filter(list_transform(range(1, len(m{rank}) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(g{rank}[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(m{rank}[1:i - 1], lambda z: length(z))), 0), 'm': m{rank}[i]}}),
    lambda x: {keep}), lambda x: {{'start': x.start::bigint, 'rank': {rank}, 'end': (x.start + length(x.m))::bigint}}) s{rank}"""

    rules = BASE + MORE
    quoted = [r.regex.replace("'", "''") for r in rules]
    found = ", ".join(f"regexp_extract_all(t, '{p}', 0) m{k}, string_split_regex(t, '{p}') g{k}" for k, p in enumerate(quoted))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    joined = lambda n: f"array_to_string(list_transform(list_sort(list_concat({', '.join(f's{k}' for k in range(n))})), lambda x: {kinds}[x.rank + 1] || ':' || x.start || ':' || x.end), ',')"
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
f as (select doc_id, {found} from d),
s as (select doc_id, {', '.join(one(k, r) for k, r in enumerate(rules))} from f)
select doc_id, len(s0)::bigint n_assign, len(s1)::bigint n_access, len(s2)::bigint n_hex,
       sha256({joined(3)}) base_sha256, {joined(len(rules))} spans from s
"""


SQL = _sql()
