"""Secret scan through a trigram index.

Every rule is a regular expression. From its syntax tree comes a Boolean query over the three-letter
strings that each match must hold. Documents are taken in blocks; a block gets an inverted index from trigrams (of the
text with A-Z lowered) to the places of its documents, for the trigrams that some query names; a letter that matches beyond ASCII under its flags is in no trigram. Postings
are intersected and united as the query says, and only the documents left are searched with the
expression. A rule without a mandatory trigram searches every document of the block.

Null text counts as empty. Rows are judged alone: nulls elsewhere, repeated rows, ties and order do not matter, an empty table
gives an empty result and other columns are not read. Places are in code points of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from re import _parser as syntax

BLOCK_BYTES = 4 << 20
MOST_STRINGS = 64  # literal alternatives followed at once
MOST_CHOICES = 4  # characters of a class followed one by one


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` of a match has to have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds every result holds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Published formats of keys and tokens whose prefix or shape tells what they are.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY( BLOCK)?-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"://[^\s/:@]+:[^\s/:@]+@"),
    Rule("age", r"AGE-SECRET-KEY-1[0-9A-Z]{58}"),
    Rule("atlassian", r"ATATT3[A-Za-z0-9_=-]{50,}"),
    Rule("azure", r"AccountKey=[A-Za-z0-9+/]{86}=="),
    Rule("databricks", r"dapi[0-9a-f]{32}"),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("discord", r"https://discord(app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+"),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]{27}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("google_client", r"(?<![0-9])[0-9]+-[0-9a-z]{32}\.apps\.googleusercontent\.com"),
    Rule("google_oauth", r"ya29\.[0-9A-Za-z_-]{20,}"),
    Rule("grafana", r"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}"),
    Rule("huggingface", r"hf_[A-Za-z]{34}"),
    Rule("linear", r"lin_api_[A-Za-z0-9]{40}"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}(?![0-9])"),
    Rule("mailgun", r"key-[0-9a-f]{32}"),
    Rule("newrelic", r"NRAK-[A-Z0-9]{27}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("openai", r"sk-[A-Za-z0-9_-]{16,}T3BlbkFJ[A-Za-z0-9_-]{16,}"),
    Rule("planetscale", r"pscale_(tkn|pw|oauth)_[A-Za-z0-9_.-]{32,}"),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("slack", r"xox[abeprs]-[0-9A-Za-z-]{10,}"),
    Rule("slack_hook", r"https://hooks\.slack\.com/services/[A-Z0-9]+/[A-Z0-9]+/[A-Za-z0-9]+"),
    Rule("square", r"sq0(atp|csp)-[0-9A-Za-z_-]{22,43}"),
    Rule("stripe", r"[rs]k_(live|test)_[0-9A-Za-z]{24,}"),
    Rule("telegram", r"[0-9]{8,10}:AA[0-9A-Za-z_-]{33}"),
    Rule("terraform", r"[A-Za-z0-9]{14}\.atlasv1\.[A-Za-z0-9_-]{60,}"),
    Rule("vault", r"hv[bs]\.[A-Za-z0-9_-]{24,}"),
)

# A query is True (any text), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


def both(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(parts: list[Query]) -> Query:
    def narrower(a: Query, b: Query) -> bool:
        """Whether ``a`` asks for all that ``b`` asks for, and more."""
        sides = [set(q[1:]) if isinstance(q, tuple) and q[0] == "and" else {q} for q in (a, b)]
        return sides[0] > sides[1]

    parts = list(dict.fromkeys(parts))
    parts = [p for p in parts if not any(narrower(p, q) for q in parts)]
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def of_strings(strings: set[str]) -> Query:
    """Texts that hold one of the strings."""
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def plain_letter(code: int, flags: int) -> bool:
    """Whether a literal matches nothing but itself and, with the flag, its other case in ASCII.

    Without the ASCII flag i, k and s also match letters beyond ASCII when case is ignored (dotted and dotless i, the Kelvin sign, long s).
    """
    wide = flags & re.IGNORECASE and not flags & re.ASCII
    return code < 128 and not (wide and chr(code) in "iIkKsS")


def inner_flags(arg: tuple, flags: int) -> int:
    return (flags | arg[1]) & ~arg[2]


def strings_of(node: tuple, flags: int) -> set[str] | None:
    """All strings a node can match, lowered, if they are few; else None."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()} if plain_letter(arg, flags) else None
    if op == "IN":
        chosen: set[str] = set()
        for kind, value in arg:
            if str(kind) != "LITERAL" or not plain_letter(value, flags) or len(chosen) > MOST_CHOICES:
                return None
            chosen.add(chr(value).lower())
        return chosen
    if op == "SUBPATTERN":
        return strings_in(arg[3], inner_flags(arg, flags))
    if op == "BRANCH":
        found = [strings_in(branch, flags) for branch in arg[1]]
        return None if None in found else set().union(*found)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 5:
        one = strings_in(arg[2], flags)
        if one is None:
            return None
        done, last = set() if arg[0] else {""}, {""}
        for times in range(1, int(arg[1]) + 1):
            last = {a + b for a in last for b in one}
            if len(last) > MOST_STRINGS:
                return None
            if times >= arg[0]:
                done |= last
        return done
    return None


def strings_in(nodes: Iterable[tuple], flags: int) -> set[str] | None:
    done = {""}
    for node in nodes:
        more = strings_of(node, flags)
        if more is None or len(done) * len(more) > MOST_STRINGS:
            return None
        done = {a + b for a in done for b in more}
    return done


def query_in(nodes: Iterable[tuple], flags: int) -> Query:
    """What every text with a match of the concatenated nodes holds."""
    parts: list[Query] = []
    run = {""}
    for node in nodes:
        more = strings_of(node, flags)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(of_strings(run))
        run = {""} if more is None else more
        op, arg = str(node[0]), node[1]
        if more is None and op == "SUBPATTERN":
            parts.append(query_in(arg[3], inner_flags(arg, flags)))
        elif more is None and op == "BRANCH":
            parts.append(either([query_in(branch, flags) for branch in arg[1]]))
        elif more is None and op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            parts.append(query_in(arg[2], flags))
    return both([*parts, of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression; True if no trigram is mandatory."""
    tree = syntax.parse(pattern)
    return query_in(tree, tree.state.flags)


def named(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(named, query[1:]))


class BlockIndex:
    """Postings of one block of texts for a set of trigrams."""

    def __init__(self, texts: list[bytes], trigrams: Iterable[str]) -> None:
        names = sorted(trigrams)
        slot = np.full(1 << 24, -1, dtype=np.int16)
        slot[[int.from_bytes(t.encode(), "big") for t in names]] = np.arange(len(names))
        # 0xFF is in no UTF-8 text, so no trigram spans two texts.
        raw = np.frombuffer(b"\xff".join(texts).lower() + b"\xff\xff\xff", dtype=np.uint8).astype(np.uint32)
        which = slot[(raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]]
        at = np.flatnonzero(which >= 0)
        ends = np.cumsum([len(t) + 1 for t in texts])
        pair = np.unique(which[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        cuts = np.searchsorted(pair, np.arange(len(names) + 1) * len(texts))
        self.postings = {t: pair[cuts[i] : cuts[i + 1]] - i * len(texts) for i, t in enumerate(names)}

    def find(self, query: Query) -> np.ndarray:
        """Sorted places of the texts that satisfy a query with a trigram in it."""
        if isinstance(query, str):
            return self.postings[query]
        found = [self.find(part) for part in query[1:]]
        join = np.intersect1d if query[0] == "and" else np.union1d
        for more in found[1:]:
            found[0] = join(found[0], more)
        return found[0]


def matches(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    spans = ((m, m.span(rule.group)) for m in expression.finditer(text))
    return [m.span() for m, (begin, end) in spans if end - begin >= rule.least]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id`` and ``found`` (kind, start, end; by start, then order of the rules) of every row."""
    id_type = docs.select(doc_id).schema[0].dataType
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("found", T.ArrayType(SPAN))])
    queries = [trigram_query(rule.pattern) for rule in rules]
    wanted = set().union(*map(named, queries))

    def block_spans(texts: list[bytes]) -> list[list[dict]]:
        index = BlockIndex(texts, wanted)
        decoded: dict[int, str] = {}
        found: list[list[tuple]] = [[] for _ in texts]
        for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            expression = re.compile(rule.pattern)
            for i in range(len(texts)) if query is True else index.find(query).tolist():
                body = decoded.get(i) or decoded.setdefault(i, texts[i].decode("utf-8", "replace"))
                found[i] += [(start, order, end) for start, end in matches(rule, expression, body)]
        return [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(f)] for f in found]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            begin = held = 0
            for i, body in enumerate(texts):
                texts[i] = body or b""
                held += len(texts[i])
                if held >= BLOCK_BYTES or i == len(texts) - 1:
                    found = pa.array(block_spans(texts[begin : i + 1]), spans)
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, i + 1 - begin), found], ["doc_id", "found"])
                    begin, held = i + 1, 0

    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return raw.mapInArrow(run, out)
