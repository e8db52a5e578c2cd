"""Full-text predicates over an inverted index, made on the spot or stored: terms, phrases, prefixes, wildcards, fuzzy terms, ranges, boosts, boolean queries; scores by BM25."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.edn import Keyword
from tidemark.model import Catalog
from tidemark.plans.parse import Pred
from tidemark.sources.stores import TableStore
from tidemark.workspace import cut

K1, B = 1.2, 0.75
#: Replaced units of a stored index that a reader broadcasts at most.
STALE_ROWS = 1_000_000
#: One value of an entity's attribute; `vh` is a hash of the text, which itself never leaves its table.
UNIT = ["attr", "e", "vh"]
#: A value that is a keyword and nothing else is no text.
_KEYWORD = r"^:[^\s:]+$"


def analyze(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def facts(catalog: Catalog, attribute: str | None = None) -> DataFrame:
    """(attr, e, vh, v) of every string attribute, or of one."""
    out = None
    for table in catalog.tables.values():
        if table.eid is None:
            continue
        for name, column in table.attributes.items():
            if attribute is not None and name != attribute:
                continue
            kind = table.df.schema[column].dataType.simpleString()
            if kind not in ("string", "array<string>"):
                continue
            value = F.explode(F.array_distinct(column)) if kind.startswith("array") else F.col(column)
            found = table.df.select(F.lit(name).alias("attr"), F.col(table.eid).cast("string").alias("e"), value.alias("v")).where(~F.col("v").rlike(_KEYWORD))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError(f"no text attribute {attribute or ''}")
    return out.select("attr", "e", F.xxhash64("v").alias("vh"), "v")


def _runs(texts: DataFrame, here: Callable[[Column], Column] | None = None) -> DataFrame:
    """(attr, e, vh, size, runs): the terms of each value, or those that are `here`, with their places. All are in the value's row, so they are sorted and cut into runs there, without a shuffle."""
    words = texts.select(*UNIT, analyze(F.col("v")).alias("words"))
    places = F.transform("words", lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    places = places if here is None else F.filter(places, lambda x: here(x["term"]))
    placed = words.select(*UNIT, F.size("words").alias("size"), F.sort_array(places).alias("places"))
    word = lambda k: F.get(F.col("places"), k)["term"]
    starts = F.filter(F.sequence(F.lit(0), F.size("places") - 1), lambda k: (k == 0) | (word(k) != word(k - 1)))
    starting = placed.withColumn("starts", F.when(F.size("places") > 0, starts))
    end = lambda n: F.coalesce(F.get(F.col("starts"), n + 1), F.size("places"))
    runs = F.transform("starts", lambda k, n: F.struct(word(k).alias("term"), F.transform(F.slice("places", k + 1, end(n) - k), lambda x: x["at"]).alias("at")))
    return starting.select(*UNIT, "size", runs.alias("runs"))


def _postings(runs: DataFrame) -> DataFrame:
    return runs.select(*UNIT, "size", F.explode("runs").alias("run")).select(*UNIT, "size", "run.term", F.size("run.at").cast("long").alias("tf"), "run.at")


def postings_of(texts: DataFrame) -> DataFrame:
    """(attr, e, vh, size, term, tf, at): how often and where each term is in each value."""
    return _postings(_runs(texts))


def index(catalog: Catalog, attribute: str | None = None) -> DataFrame:
    """The postings of every string attribute, or of one."""
    return postings_of(facts(catalog, attribute))


# Queries.


@dataclass(eq=False)
class Term:
    """A word, a pattern with * and ?, a fuzzy word (`edits`), a range of words (`low`, `high`: None is open), or a phrase of several `words` with up to `slop` words more between them."""

    text: str
    field: str | None = None
    boost: float = 1.0
    edits: int = 0
    low: tuple[str, bool] | None = None
    high: tuple[str, bool] | None = None
    words: tuple[str, ...] = ()
    slop: int = 0

    def matches(self, term: Column) -> Column:
        if self.words:
            return term.isin(*self.words)
        if self.low is not None or self.high is not None:
            above = F.lit(True) if self.low is None else term >= self.low[0] if self.low[1] else term > self.low[0]
            return above & (F.lit(True) if self.high is None else term <= self.high[0] if self.high[1] else term < self.high[0])
        if self.edits:
            return F.levenshtein(term, F.lit(self.text), self.edits) >= 0
        if re.search(r"[*?]", self.text):
            if re.fullmatch(r"[^*?]+\*", self.text):
                return term.startswith(self.text[:-1])
            return term.rlike("^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in self.text) + "$")
        return term == self.text

    def here(self, term: Column | None = None) -> Column:
        held = self.matches(F.col("term") if term is None else term)
        return held if self.field is None else held & (F.col("attr") == self.field)


_TOKEN = re.compile(r'\(|\)(?:\^[\d.]+)?|(?:[^\s()":]+:)?"[^"]*"(?:~\d+)?(?:\^[\d.]+)?|(?:[^\s()":]+:)?[\[{][^\]}]*[\]}](?:\^[\d.]+)?|[^\s()]+')


def _leaf(token: str) -> tuple:
    name, text = None, token
    if m := re.match(r'([^\s():"\[{]+):(.+)$', token):
        name, text = m[1], m[2]
    boost = 1.0
    if m := re.search(r"\^([\d.]+)$", text):
        text, boost = text[: m.start()], float(m[1])
    if m := re.fullmatch(r"([\[{])\s*(\S+)\s+TO\s+(\S+)\s*([\]}])", text):
        bound = lambda word, closed: None if word == "*" else (word.strip('"').lower(), closed)
        return "term", [Term(text, name, boost, low=bound(m[2], m[1] == "["), high=bound(m[3], m[4] == "]"))]
    if m := re.fullmatch(r'"([^"]*)"(?:~(\d+))?', text):
        words = tuple(re.findall(r"[^\W_]+", m[1].lower()))
        return "term", [Term(words[0] if words else "", name, boost) if len(words) < 2 else Term(m[1], name, boost, words=words, slop=int(m[2] or 0))]
    text = text.strip('"').lower()
    if m := re.fullmatch(r"([^\W_]+)~(\d?)(?:\.\d+)?", text):
        return "term", [Term(m[1], name, boost, edits=int(m[2] or 2))]
    words = re.findall(r"[^\W_*?]+[*?\w]*|[*?]\w*", text) or [text]
    terms = [("term", [Term(w, name, boost)]) for w in words]
    return terms[0] if len(terms) == 1 else ("and", terms)


def parse_text(query: str) -> tuple:
    """("or" | "and" | "not", parts) over Terms: AND, OR, NOT, +, -, parentheses, field:term, "a phrase"~slop, term~edits, [a TO b], {a TO b}, ^boost; terms side by side are alternatives, unless some are marked with + or -."""
    tokens = _TOKEN.findall(query)
    at = 0

    def either() -> tuple:
        nonlocal at
        parts, must, never = [], [], []
        while at < len(tokens) and not tokens[at].startswith(")"):
            if tokens[at] in ("OR", "||"):
                at += 1
                continue
            sign = tokens[at][0] if tokens[at][0] in "+-" and len(tokens[at]) > 1 else ""
            part = both()
            (must if sign == "+" else never if sign == "-" else parts).append(part)
        if must or (never and parts):
            # Without a + the others are alternatives; with one they add to the score only.
            wanted = must if must else [parts[0] if len(parts) == 1 else ("or", parts)]
            return "and", [*wanted, *never, *([("may", parts)] if must and parts else [])]
        parts += never
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both() -> tuple:
        nonlocal at
        parts = [one()]
        while at < len(tokens) and tokens[at] in ("AND", "&&"):
            at += 1
            parts.append(one())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def one() -> tuple:
        nonlocal at
        token = tokens[at]
        at += 1
        if token in ("NOT", "!"):
            return "not", [one()]
        if token == "(":
            inner = either()
            boost = float(tokens[at][2:]) if at < len(tokens) and "^" in tokens[at] else 1.0
            at += 1
            for t, _ in _terms(inner):
                t.boost *= boost
            return inner
        if token.startswith("-") and len(token) > 1:
            return "not", [_leaf(token[1:])]
        return _leaf(token.lstrip("+"))

    return either()


def _terms(tree: tuple, wanted: bool = True) -> list[tuple[Term, bool]]:
    kind, parts = tree
    if kind == "term":
        return [(parts[0], wanted)]
    return [t for p in parts for t in _terms(p, wanted if kind != "not" else not wanted)]


def _holds(tree: tuple, flags: dict[int, Column]) -> Column:
    kind, parts = tree
    if kind == "term":
        return flags[id(parts[0])]
    if kind == "may":
        return F.lit(True)
    inner = [_holds(p, flags) for p in parts]
    if kind == "not":
        return ~inner[0]
    return reduce(lambda a, b: a & b if kind == "and" else a | b, inner)


def _phrase(places: Column, term: Term) -> Column:
    """How often the phrase is there: places of its first word after which the others follow in order, with `slop` words more at most."""

    def after(word: str, before: Column, most: Column) -> Column:
        return F.array_min(F.filter(F.element_at(places, F.lit(word)), lambda x: (x > before) & (x <= most)))

    def starts(p: Column) -> Column:
        last = p
        for k, word in enumerate(term.words[1:], 1):
            last = after(word, last, p + F.lit(k + term.slop))
        return last.isNotNull()

    whole = reduce(lambda a, b: a & b, [F.map_contains_key(places, w) for w in dict.fromkeys(term.words)])
    return F.when(whole, F.size(F.filter(F.element_at(places, F.lit(term.words[0])), starts))).otherwise(0)


def search(postings: DataFrame, query: str, keys: list[str], totals: DataFrame | None = None) -> DataFrame:
    """(keys..., score) of the units, one for each value of `keys`, that satisfy the query.

    Only postings of the query's terms leave the scan. Rarities come from these; `totals` (n, mean)
    of all units, if not given, from the postings. A phrase weighs as the sum of its words'
    rarities, at its own frequency.
    """
    tree = parse_text(query)
    if totals is None:
        totals = _totals(postings.groupBy(*keys).agg(F.max("size").alias("size")))
    return _scored(postings.where(_any(tree, F.col("term"))), tree, keys, totals)


def search_texts(texts: DataFrame, query: str, keys: list[str], whole: bool = False) -> DataFrame:
    """As search(), from values (attr, e, vh, v), which are read once: the size and the places of the query's terms in each are written, and all else starts there. `whole`: the size of a unit is that of all values of its entity."""
    tree = parse_text(query)
    values = cut(_runs(texts, lambda term: _any(tree, term)), "text")
    sizes = values.where("size > 0").groupBy(*UNIT).agg(F.max("size").alias("size"))
    units = sizes.groupBy(*(["e"] if whole else keys)).agg((F.sum if whole else F.max)("size").alias("size"))
    hits = _postings(values.where("runs IS NOT NULL"))
    return _scored(hits.drop("size").join(units, "e") if whole else hits, tree, keys, _totals(units))


def _any(tree: tuple, term: Column) -> Column:
    return reduce(lambda a, b: a | b, [t.here(term) for t, _ in _terms(tree)])


def _totals(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))


def _scored(hits: DataFrame, tree: tuple, keys: list[str], totals: DataFrame) -> DataFrame:
    terms = [t for t, _ in _terms(tree)]
    counted = {k for k, (_, wanted) in enumerate(_terms(tree)) if wanted}
    rarity = hits.select("term", *keys).distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rarity = rarity.join(F.broadcast(totals)).select("term", "mean", idf.alias("idf"))
    single = [k for k, t in enumerate(terms) if not t.words]
    rows = hits.withColumn("leaf", F.explode(F.array_compact(F.array(*[F.when(terms[k].here(), F.lit(k)) for k in single])))) if single else None
    parts = []
    if rows is not None:
        # A term may be there in several attributes or values of one unit.
        whole = rows.groupBy(*keys, "leaf", "term").agg(F.sum("tf").alias("tf"), F.max("size").alias("size"))
        parts.append(whole.join(rarity, "term").select(*keys, "leaf", "tf", "size", "mean", "idf"))
    unit = list(dict.fromkeys([*keys, "attr", "e", *(["vh"] if "vh" in hits.columns else [])]))
    for k, t in enumerate(terms):
        if t.words:
            # Rows that hold the same value of an entity count together.
            once = hits.where(t.here()).groupBy(*unit, "term").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"), F.max("size").alias("size"))
            held = once.groupBy(*unit).agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("places"), F.max("size").alias("size"))
            found = held.select(*keys, "size", _phrase(F.col("places"), t).alias("tf")).where("tf > 0").groupBy(*keys).agg(F.sum("tf").alias("tf"), F.max("size").alias("size"))
            heavy = rarity.where(F.col("term").isin(*t.words)).agg(F.sum("idf").alias("idf"), F.max("mean").alias("mean"))
            parts.append(found.join(F.broadcast(heavy)).select(*keys, F.lit(k).alias("leaf"), "tf", "size", "mean", "idf"))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    boost = F.element_at(F.array(*[F.lit(t.boost if k in counted else 0.0) for k, t in enumerate(terms)]), F.col("leaf") + 1)
    found = every.groupBy(*keys).agg(F.sum(weight * boost).alias("score"), *[F.max(F.col("leaf") == k).alias(f"__{k}") for k in range(len(terms))])
    return found.where(_holds(tree, {id(t): F.col(f"__{k}") for k, t in enumerate(terms)})).select(*keys, "score")


class TextIndex:
    """Stored postings under a path, in segments sorted by term, each made by one task from the values that it read, so that a search reads the pages of its terms only and no posting is shuffled.

    update() indexes the values of changed entities anew; a reader takes each entity's last batch,
    so an entity without values (deleted or evicted) is gone. compact() writes one base.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.postings, self.units = TableStore(spark, f"{self.path}/postings"), TableStore(spark, f"{self.path}/units")

    def _write(self, made: DataFrame, units: DataFrame, batch: int, base: bool = False) -> None:
        self.postings.write(made.withColumn("batch", F.lit(batch).cast("long")), batch, ["term", "e"], base=base)
        self.units.write(units.withColumn("batch", F.lit(batch).cast("long")), batch, ["e"], base=base)

    def update(self, texts: DataFrame, batch: int, entities: DataFrame | None = None) -> None:
        """Index all values (attr, e, vh, v) of the entities of a batch; `entities` (e) are those that changed, if some have no values left. A batch that runs again changes nothing."""
        held = texts.withColumn("size", F.size(analyze(F.col("v")))).groupBy("e").agg(F.count_if(F.col("size") > 0).alias("values"), F.sum("size").alias("size"))
        if entities is not None:
            held = entities.select(F.col("e").cast("string").alias("e")).distinct().join(held, "e", "left").fillna(0, ["values", "size"])
        self._write(postings_of(texts), held, batch)

    def build(self, catalog: Catalog, attribute: str | None = None, batch: int = 0) -> TextIndex:
        self.update(facts(catalog, attribute), batch)
        return self

    def _last(self) -> DataFrame:
        return self.units.read().groupBy("e").agg(F.max_by(F.struct("batch", "values", "size"), "batch").alias("u")).select("e", "u.*")

    def _batches(self) -> int:
        return len(self.units._live())

    def current(self) -> DataFrame:
        """The postings of each entity's last batch. What later batches replaced is counted first: up to STALE_ROWS of it is broadcast, as the other way all postings are shuffled."""
        rows = self.postings.read()
        if self._batches() > 1:
            stale = self.units.read().select("e", "batch").join(self._last().select("e", F.col("batch").alias("last")), "e").where("batch < last").select("e", "batch").distinct()
            if stale.count() <= STALE_ROWS:
                stale = F.broadcast(stale)
            return rows.join(stale, ["e", "batch"], "left_anti").drop("batch")
        return rows.drop("batch")

    def totals(self) -> DataFrame:
        """(n, mean): values and their mean size, from the small table of units."""
        return self._last().agg(F.sum("values").cast("long").alias("n"), (F.sum("size") / F.sum("values")).alias("mean"))

    def latest_tx(self) -> int | None:
        return self.units.last_order()

    def compact(self) -> None:
        order = self.latest_tx()
        if order is not None and self._batches() > 1:
            self._write(self.current(), self._last().drop("batch").where("values > 0"), order, base=True)
            self.postings.prune()
            self.units.prune()

    def search(self, query: str, attribute: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """(attr, e, vh, score), the best first, a page at a time if limited."""
        rows = self.current() if attribute is None else self.current().where(F.col("attr") == attribute)
        found = search(rows, query, UNIT, self.totals() if attribute is None else None).orderBy(F.desc("score"), "e", "attr", "vh")
        found = found.offset(offset) if offset else found
        return found if limit is None else found.limit(limit)


# Clauses.


def _query_text(args: list) -> str:
    text, rest = args[0], list(args[1:])
    return text % tuple(rest) if rest else text


def _search(catalog: Catalog, query: str, keys: list[str], attribute: str | None = None) -> DataFrame:
    """A search of the stored index, or of the values themselves if there is none."""
    if catalog.text is None:
        return search_texts(facts(catalog, attribute), query, keys)
    rows = catalog.text.current()
    return search(rows if attribute is None else rows.where(F.col("attr") == attribute), query, keys)


def text_search(compiler: object, x: Pred, df: DataFrame) -> DataFrame:
    """[(text-search :attr "query") [[e v score]]]; texts join the hits at last, those that hold at the basis only."""
    name = x.args[0].name if isinstance(x.args[0], Keyword) else str(x.args[0])
    found = _search(compiler.catalog, _query_text(x.args[1:]), ["e", "vh"], name)
    return _bound(found.join(facts(compiler.catalog, name), ["e", "vh"]).select("e", "v", "score"), x)


def wildcard_text_search(compiler: object, x: Pred, df: DataFrame) -> DataFrame:
    """[(wildcard-text-search "query") [[e v a score]]]"""
    found = _search(compiler.catalog, _query_text(x.args), ["e", "vh", "attr"])
    return _bound(found.join(facts(compiler.catalog), ["e", "vh", "attr"]).select("e", "v", "attr", "score"), x)


def multi_field(postings: DataFrame) -> DataFrame:
    """Postings whose size is that of all values of the entity."""
    sizes = postings.select(*UNIT, "size").distinct().groupBy("e").agg(F.sum("size").alias("whole"))
    return postings.join(sizes, "e").withColumn("size", F.col("whole")).drop("whole")


def multi_field_search(compiler: object, x: Pred, df: DataFrame) -> DataFrame:
    """[(multi-text-search "a:%s AND b:%s" args...) [[e score]]]: one unit for each entity."""
    if compiler.catalog.text is None:
        found = search_texts(facts(compiler.catalog), _query_text(x.args), ["e"], whole=True)
    else:
        found = search(multi_field(compiler.catalog.text.current()), _query_text(x.args), ["e"])
        found = found.join(facts(compiler.catalog).select("e").distinct(), "e", "left_semi")
    return _bound(found.select("e", "score"), x)


def _bound(found: DataFrame, x: Pred) -> DataFrame:
    shape, names = x.binding or ("relation", [])
    names = [names] if isinstance(names, str) else list(names)
    kept = found.select(*[F.col(c).alias(n) for c, n in zip(found.columns, names, strict=False)])
    return kept if {"e", "v"} <= set(found.columns[: len(names)]) else kept.distinct()


CONSTRAINTS = {"text-search": text_search, "wildcard-text-search": wildcard_text_search, "multi-text-search": multi_field_search, "lucene-text-search": multi_field_search}
