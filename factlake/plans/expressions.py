"""What names in expressions mean, and what types expressions have.

An expression is known by the place of its own sign, and holds the place of the expression that it is
applied to: behind a dot the receiver, in front of a bracket what is accessed, behind ``await`` what is
awaited, at a variable without a written type its first value, at a parameter of a lambda the call
whose argument the lambda is. These places are edges, and types travel along them a step a round, all
chains at once: what the last round typed is joined with the edges that lead on from it (semi-naive
evaluation), until a round finds nothing new. So the rounds are as many as the longest chain has steps,
and each reads only what is new. What doesn't change from round to round is joined once, before them: what
each member is worth, a type's indexer, and where a variable's type goes. A round is two tables, candidates
and values; candidates come with what they are worth, so that values need no join for it.

A type is a text together with the file and the namespace in which it is written, since that decides
what its names mean; or the declaration itself, for the name of a type.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.storage import Growing, written

GLOBAL = "<global>"
KEY = ["doc_id", "start"]
#: The language's implicit numeric conversions, each type with the wider ones, nearest first.
WIDER = {
    "sbyte": "short int long float double decimal", "byte": "short ushort int uint long ulong float double decimal", "short": "int long float double decimal",
    "ushort": "int uint long ulong float double decimal", "int": "long float double decimal", "uint": "long ulong float double decimal",
    "long": "float double decimal", "ulong": "float double decimal", "char": "ushort int uint long ulong float double decimal", "float": "double",
}
KEYWORD_TYPES = (*WIDER, "double", "decimal", "bool", "string", "object")
KNOWN = ("type_text", "ctx_doc", "ctx_space", "type_id")
#: What a type is worth: also its type arguments, what it holds, and what its declaration's indexer gives.
WORTH = (*KNOWN, "arguments", "element", "indexer")
#: A value: the type of the expression at a place, its declaration where that is known, and what it is worth.
VALUE = ("doc_id", "at", *WORTH)
#: The language's implicit numeric conversions, each type with the wider ones, nearest first.
WIDER = {
    "sbyte": "short int long float double decimal", "byte": "short ushort int uint long ulong float double decimal", "short": "int long float double decimal",
    "ushort": "int uint long ulong float double decimal", "int": "long float double decimal", "uint": "long ulong float double decimal",
    "long": "float double decimal", "ulong": "float double decimal", "char": "ushort int uint long ulong float double decimal", "float": "double",
}
KEYWORD_TYPES = (*WIDER, "double", "decimal", "bool", "string", "object")
#: A value: the type of the expression at a place; ``type_id`` where the declaration is known.


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def bind_types(rows: DataFrame, types: DataFrame, scopes: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``found_type``: the types that (doc_id, namespace, qualifier, name) of each row means.

    The nearest namespace that has the name decides; a qualified name also matches a whole namespace.
    """
    known = types.select(F.col("type_id").alias("found_type"), "name", F.col("namespace").alias("target"))
    inside = F.when(F.col("qualifier").isNull(), F.col("target")).when(F.col("target") == GLOBAL, F.col("qualifier")).otherwise(F.concat_ws(".", "target", "qualifier"))
    hit = rows.join(scopes, ["doc_id", "namespace"]).withColumn("target", inside).join(known, ["name", "target"])
    best = hit.withColumn("best", F.min("rank").over(Window.partitionBy(*key))).filter("rank = best")
    return best.select(*key, "found_type").distinct()


def plain_type(type_text: Column) -> Column:
    """A type's text without the words that may stand in front of it."""
    return F.regexp_replace(F.trim(type_text), r"^(?:(?:this|ref|out|in|params|readonly|scoped)\s+)+", "")


def bare(type_text: Column) -> Column:
    """The name in a type's text, without modifiers, type arguments, ranks and question marks."""
    return F.regexp_extract(plain_type(type_text), r"^([\w.]+)", 1)


def split_name(text: Column) -> list[Column]:
    last = F.substring_index(text, ".", -1)
    return [last.alias("name"), F.nullif(F.substring(text, F.lit(1), F.length(text) - F.length(last) - 1), F.lit("")).alias("qualifier")]


def number_type(text: Column) -> Column:
    """The type of a number by how it is written; in hex digits, e and f are no marks."""
    hex_ = text.rlike("(?i)^0[xb]")
    return (
        F.when(text.rlike("(?i)(ul|lu)$"), "ulong").when(text.rlike("(?i)l$"), "long").when(text.rlike("(?i)u$"), "uint").when(hex_, "int")
        .when(text.rlike("(?i)m$"), "decimal").when(text.rlike("(?i)f$"), "float").when(text.rlike("(?i)[.ed]"), "double").otherwise("int")
    )


def type_arguments(type_text: Column) -> Column:
    """The type arguments of a type's text, an empty array if it has none; any depth of brackets."""
    inside = F.regexp_extract(plain_type(type_text), r"(?s)^[\w.]+\s*<(.*)>\??$", 1)

    def step(state: Column, c: Column) -> Column:
        deep = state["deep"] + F.when(c.isin("<", "(", "["), 1).when(c.isin(">", ")", "]"), -1).otherwise(0)
        cut = (c == ",") & (state["deep"] == 0)
        out = F.when(cut, F.concat(state["out"], F.array(F.lit("")))).otherwise(
            F.concat(F.slice(state["out"], F.lit(1), F.size(state["out"]) - 1), F.array(F.concat(F.element_at(state["out"], -1), c)))
        )
        return F.struct(deep.cast("int").alias("deep"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("deep"), F.array(F.lit("")).alias("out"))
    parts = F.transform(F.aggregate(F.split(inside, ""), begin, step)["out"], lambda x: F.trim(x))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(parts)


def element_type(type_text: Column, arguments: Column) -> Column:
    """What an array or a collection with these type arguments holds: of several of them the last."""
    text = F.regexp_replace(type_text, r"\?$", "")
    return (
        F.when(text.rlike(r"\[,*\]$"), F.regexp_replace(text, r"\[,*\]$", "")).when(F.size(arguments) > 0, F.try_element_at(arguments, F.lit(-1)))
        .when(text == "string", F.lit("char"))
    )


def conversions() -> list[tuple[str, str, int]]:
    """(type, wider type, steps) of the implicit numeric conversions."""
    return [(a, b, n) for a, wider in WIDER.items() for n, b in enumerate(wider.split(), 1)]


class Bindings:
    """Names bound to locals, members and types, over the sites, expressions and declarations of all documents."""

    def __init__(self, sites: DataFrame, others: DataFrame, types: DataFrame, members: DataFrame, locals_: DataFrame, scopes: DataFrame, bases: DataFrame):
        self.sites, self.others, self.types, self.members, self.locals, self.scopes, self.bases = sites, others, types, members, locals_, scopes, bases
        where = [F.col("doc_id").alias("ctx_doc"), F.col("namespace").alias("ctx_space")]
        inside = bases.join(members.filter("kind = 'indexer'").select(F.col("type_id").alias("base_id"), plain_type(F.col("type_text")).alias("held"), *where), "base_id")
        self.indexers = written(inside.groupBy("type_id").agg(F.min_by(F.struct("held", "ctx_doc", "ctx_space"), "distance").alias("indexer")), "indexers")
        self.texts = self._type_texts()
        self.results = self._results()
        last = F.get("params", F.col("n_params").cast("int") - 1)["type"]
        own = members.filter("kind not in ('constructor', 'destructor')").select(
            F.col("type_id").alias("base_id"), F.col("member_id").alias("symbol_id"), "name", "n_params", "n_required",
            F.coalesce(last.startswith("params "), F.lit(False)).alias("many"), (F.col("kind") == "method").alias("is_method"),
        )
        self.extensions = members.filter("is_extension").select("name", F.col("namespace").alias("target"), F.col("member_id").alias("symbol_id"))
        self.holds = members.select(
            F.col("member_id").alias("symbol_id"), F.col("kind").alias("member_kind"), plain_type(F.col("type_text")).alias("type_text"), *where, F.col("type_id").alias("owner")
        )
        params = members.select(F.col("member_id").alias("symbol_id"), "is_extension", *where, F.posexplode("params").alias("i", "p"))
        params = params.withColumn("type_text", plain_type(F.col("p.type"))).withColumn("spread", F.col("p.type").startswith("params "))
        self.parameters = written(self._looked_up(params).select("symbol_id", "is_extension", "i", "spread", *KNOWN, "element", "arguments"), "parameters")
        self.worth = written(self._worth(), "worth")
        self.has = written(bases.join(own, "base_id").drop("base_id").join(self.worth, "symbol_id", "left"), "has")

    def _type_texts(self) -> DataFrame:
        """``(type_text, ctx_doc, ctx_space, found_type, arguments, element, indexer)`` of all type texts and of the texts inside them.

        Each distinct text is taken apart and looked up once, so the rounds that follow only join with this.
        """
        where = ["doc_id", "namespace"]
        written_ones = self.locals.filter("given_type is not null").withColumnRenamed("space", "namespace")
        all_ = self.members.select(F.col("type_text"), *where).unionByName(self.members.select(F.explode("params.type").alias("type_text"), *where))
        all_ = all_.unionByName(written_ones.select(F.col("given_type").alias("type_text"), *where)).unionByName(self.others.select("type_text", *where))
        new = all_.filter("type_text is not null").select(plain_type(F.col("type_text")).alias("type_text"), *where).distinct()
        known = Growing("texts")
        while True:
            apart = new.withColumn("arguments", type_arguments(F.col("type_text")))
            apart = known.add(apart.withColumn("element", element_type(F.col("type_text"), F.col("arguments"))))
            inner = apart.select(F.explode(F.array_compact(F.concat("arguments", F.array("element")))).alias("type_text"), *where).filter("type_text <> ''").distinct()
            new = inner.join(known.table(), ["type_text", *where], "left_anti")
            if new.isEmpty():
                break
        texts = known.table()
        asked = texts.filter(~F.col("type_text").rlike(r"[\])]\??$")).select("type_text", *where, bare(F.col("type_text")).alias("b"))
        found = bind_types(asked.select("type_text", *where, *split_name(F.col("b"))), self.types, self.scopes, ["type_text", *where])
        found = found.join(self.indexers.withColumnRenamed("type_id", "found_type"), "found_type", "left")
        out = texts.join(found, ["type_text", *where], "left")
        return written(out.withColumnsRenamed({"doc_id": "ctx_doc", "namespace": "ctx_space"}), "type-texts")

    def _results(self) -> DataFrame:
        """The type texts with what a called delegate of the type gives back, ``result``: its last type argument, looked up as well."""
        given = self.texts.select(F.col("type_text").alias("result"), "ctx_doc", "ctx_space", F.struct(F.col("found_type").alias("type_id"), "arguments", "element", "indexer").alias("given"))
        return written(self.texts.withColumn("result", F.try_element_at("arguments", F.lit(-1))).join(given, ["result", "ctx_doc", "ctx_space"], "left"), "results")

    def _looked_up(self, rows: DataFrame) -> DataFrame:
        """Rows of (type_text, ctx_doc, ctx_space, ...) with what their texts mean and hold."""
        out = rows.join(self.texts, ["type_text", "ctx_doc", "ctx_space"], "left")
        known = F.coalesce("type_id", "found_type") if "type_id" in rows.columns else F.col("found_type")
        return out.withColumn("type_id", known).drop("found_type")

    # -- one step each

    def nearest(self, rows: DataFrame, extensions: DataFrame | None = None) -> DataFrame:
        """``(doc_id, start, n_args, symbol_id, worth, n)``: what the names of rows (doc_id, start, type_id, name, n_args, namespace) may mean.

        Members of the nearest type, of methods those that take the number of arguments, or all if none
        does; where no type has the name, those of ``extensions``, what ``extended`` gives for all names
        that may be asked. ``n`` counts a site's candidates.
        """
        hit = rows.join(self.has, ["type_id", "name"])
        fits = ~F.col("is_method") | F.col("n_args").isNull() | ((F.col("n_args") >= F.col("n_required")) & ((F.col("n_args") <= F.col("n_params")) | F.col("many")))
        out = hit.select(*KEY, "n_args", "symbol_id", "worth", F.struct(F.col("distance").alias("d"), (~fits).cast("int").alias("misfit")).alias("rank"))
        if extensions is not None:
            last = F.struct(F.lit(1 << 30).alias("d"), F.lit(0).alias("misfit"))
            out = out.unionByName(extensions.join(rows.select(*KEY), KEY, "left_semi").withColumn("rank", last))
        best = out.withColumn("best", F.min("rank").over(Window.partitionBy(*KEY))).filter("rank = best").select(*KEY, "n_args", "symbol_id", "worth").distinct()
        return best.withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))

    def extended(self, rows: DataFrame) -> DataFrame:
        """``(doc_id, start, n_args, symbol_id, worth)``: the extension methods in scope that have the names of rows."""
        asked = rows.select(*KEY, "n_args", "namespace", "name").distinct()
        hit = asked.join(self.scopes, ["doc_id", "namespace"]).join(self.extensions, ["name", "target"]).select(*KEY, "n_args", "symbol_id").distinct()
        return hit.join(self.worth, "symbol_id", "left").select(*KEY, "n_args", "symbol_id", "worth")

    def types_at(self, rows: DataFrame) -> DataFrame:
        """``(doc_id, start, whole, symbol_id)``: the types that names mean; ``whole`` tells those with a qualifier."""
        return bind_types(rows.withColumn("whole", F.col("qualifier").isNotNull()), self.types, self.scopes, [*KEY, "whole"]).withColumnRenamed("found_type", "symbol_id")

    def _worth(self) -> DataFrame:
        """``(symbol_id, worth)``: the values of a member where it is named or ``called``: what a property holds, a method returns, a delegate gives back."""
        method, called = F.col("member_kind") == "method", F.col("called")
        rows = self.holds.withColumn("called", F.explode(F.array(F.lit(False), F.lit(True)))).filter((method == called) | ~method)
        rows = rows.withColumn("type_id", F.when(F.col("member_kind") == "enummember", F.col("owner"))).withColumn("delegate", ~method & called)
        rows = rows.withColumn("own_indexer", self._unknown_type[1])  # an enum has none
        return self.typed(rows, "symbol_id", "called").groupBy("symbol_id").agg(F.collect_set(F.struct("called", *WORTH)).alias("worth"))

    @staticmethod
    def member_values(bound: DataFrame) -> DataFrame:
        """The values of (doc_id, start, n_args, worth)."""
        meant = F.filter("worth", lambda w: w["called"] == F.col("n_args").isNotNull())
        return bound.select("doc_id", F.col("start").alias("at"), F.explode(meant).alias("w")).select("doc_id", "at", *(F.col(f"w.{c}") for c in WORTH))

    def typed(self, rows: DataFrame, *key: str) -> DataFrame:
        """Values (key, type_text, ctx_doc, ctx_space, type_id, own_indexer, delegate) with what their texts mean; a called delegate's is its last type argument.

        ``own_indexer`` is that of ``type_id``, where this is known already.
        """
        rows = rows.filter("type_id is not null or type_text is not null and type_text <> 'void'")
        out = rows.join(self.results, ["type_text", "ctx_doc", "ctx_space"], "left").filter("not delegate or result is not null")
        of = lambda c, own, given: F.when(F.col("delegate"), F.col(given)).otherwise(own).alias(c)
        return out.select(
            *key, of("type_text", F.col("type_text"), "result"), "ctx_doc", "ctx_space", of("type_id", F.coalesce("type_id", "found_type"), "given.type_id"),
            *(of(c, F.col(c), f"given.{c}") for c in ("arguments", "element")),
            of("indexer", F.when(F.col("type_id").isNotNull(), F.col("own_indexer")).otherwise(F.col("indexer")), "given.indexer"),
        )

    # -- overloads

    @cached_property
    def arguments(self) -> DataFrame:
        """``(doc_id, start, i, at)``: where the arguments of calls begin, -1 for those that are no one expression."""
        return written(self.sites.select(*KEY, F.posexplode("arg_starts").alias("i", "at")), "arguments")

    def ready(self, pending: DataFrame, values: DataFrame) -> DataFrame:
        """Candidates of the calls whose arguments are typed; if there are none, of those that hold no call that waits itself."""
        given = self.arguments.filter("at >= 0").join(pending.select(*KEY).distinct(), KEY)
        untyped = given.join(values.select("doc_id", "at"), ["doc_id", "at"], "left_anti").select(*KEY).distinct()
        first = written(pending.join(untyped, KEY, "left_anti"), "ready")
        if not first.isEmpty():
            return first
        waits = pending.select("doc_id", F.col("start").alias("at")).distinct()
        return written(pending.join(given.join(waits, ["doc_id", "at"]).select(*KEY).distinct(), KEY, "left_anti"), "ready")

    def better_overloads(self, candidates: DataFrame, values: DataFrame) -> DataFrame:
        """Of the candidates (doc_id, start, n_args, symbol_id, worth) of calls, those that no other one is better than.

        A method applies if each argument converts to its parameter. It is better than another if no
        argument converts worse, and one better. Arguments of unknown type convert to anything; where no
        method applies, all are kept.
        """
        first = values.groupBy("doc_id", "at").agg(F.min(F.struct("type_text", "type_id")).alias("v"))
        given = self.arguments.join(candidates.select(*KEY).distinct(), KEY).join(first, ["doc_id", "at"], "left")
        given = given.select(*KEY, "i", F.col("v.type_text").alias("has"), F.col("v.type_id").alias("has_id"))
        behind = self.sites.select(*KEY, F.col("receiver").isNotNull().alias("behind"))
        m = self.members.select(F.col("member_id").alias("symbol_id"), "n_params", "is_extension")
        rows = candidates.select(*KEY, "symbol_id").join(behind, KEY).join(m, "symbol_id").join(given, KEY, "left")
        place = F.least(F.col("i") + (F.col("is_extension") & F.col("behind")).cast("int"), F.col("n_params").cast("int") - 1)
        wanted = self.parameters.select("symbol_id", F.col("i").alias("place"), "spread", F.col("type_text").alias("wants"), F.col("type_id").alias("wants_id"), "element")
        rows = rows.withColumn("place", place).join(wanted, ["symbol_id", "place"], "left")
        listed = F.coalesce(F.col("spread"), F.lit(False)) & ~F.coalesce(F.col("has").rlike(r"\]$"), F.lit(False))
        rows = rows.withColumn("wants", F.when(listed, F.col("element")).otherwise(F.col("wants"))).withColumn("listed", listed)
        up = self.bases.select(F.col("type_id").alias("has_id"), F.col("base_id").alias("wants_id"), F.col("distance").alias("up"))
        widening = self.sites.sparkSession.createDataFrame(conversions(), "has string, wants string, wider int")
        rows = rows.join(up, ["has_id", "wants_id"], "left").join(F.broadcast(widening), ["has", "wants"], "left")  # a few dozen rows
        keyword, from_keyword, declared = F.col("wants").isin(*KEYWORD_TYPES), F.coalesce(F.col("has").isin(*KEYWORD_TYPES), F.lit(False)), F.col("wants_id").isNotNull()
        cost = (
            F.when(F.col("i").isNull() | (F.col("has").isNull() & F.col("has_id").isNull()), 0).when((F.col("has") == F.col("wants")) | (F.col("has_id") == F.col("wants_id")), 0)
            .when(F.col("up").isNotNull(), F.col("up")).when(F.col("wider").isNotNull(), F.col("wider")).when(F.col("wants") == F.concat("has", F.lit("?")), 1)
            .when(F.col("wants") == "object", 1000).when(keyword | (declared & (F.col("has_id").isNotNull() | from_keyword)), None).otherwise(500)
        )
        rows = rows.withColumn("cost", cost + F.when(F.col("listed"), 2000).otherwise(0)).withColumn("i", F.coalesce("i", F.lit(-1)))
        costs = F.transform(F.sort_array(F.collect_list(F.struct("i", "cost"))), lambda x: x["cost"])
        rows = rows.groupBy(*KEY, "symbol_id").agg(costs.alias("costs")).withColumn("applies", F.forall("costs", lambda c: c.isNotNull()))
        rows = written(rows.withColumn("some", F.max("applies").over(Window.partitionBy(*KEY))), "costs")
        able = rows.filter("applies").select(*KEY, "symbol_id", "costs")
        both = F.arrays_zip(F.col("costs").alias("a"), F.col("theirs").alias("b"))
        beaten = able.join(able.select(*KEY, F.col("costs").alias("theirs")), KEY)
        beaten = beaten.filter(F.forall(both, lambda x: x["b"] <= x["a"]) & F.exists(both, lambda x: x["b"] < x["a"])).select(*KEY, "symbol_id").distinct()
        best = rows.filter("applies or not some").join(beaten, [*KEY, "symbol_id"], "left_anti").select(*KEY, "symbol_id")
        return candidates.join(best, [*KEY, "symbol_id"], "left_semi")

    # -- all of it

    def solve(self) -> tuple[DataFrame, DataFrame]:
        """References (without declarations), and ``(symbol_id, inferred)``, the types of variables that have none written."""
        sites = self.sites
        local = sites.filter("local_id is not null").withColumnRenamed("local_id", "symbol_id")
        plain, behind = sites.filter("receiver is null"), sites.filter("receiver is not null")
        rest = plain.filter("local_id is null")
        ask = ("doc_id", "start", "type_id", "name", "n_args", "namespace")
        up = self.bases.filter("distance = 1").select("type_id", "base_id")
        theirs = behind.filter("receiver = 'base'").join(up, "type_id").drop("type_id").withColumnRenamed("base_id", "type_id")
        asked = rest.filter("type_id is not null").select(*ask).unionByName(behind.filter("receiver = 'this'").select(*ask)).unionByName(theirs.select(*ask))
        candidates, values = Growing("candidates"), Growing("values")
        own = candidates.add(self.nearest(asked).withColumn("round", F.lit(1)))
        sure = "n = 1 or n_args is null"
        inner = own.filter(sure)
        # What is left without a receiver may be a type; names behind names may be a type of a namespace.
        left = rest.join(own.select(*KEY).distinct(), KEY, "left_anti")
        dotted = behind.filter("receiver <> '?'").select(*KEY, "namespace", "name", F.col("receiver").alias("qualifier"))
        named = written(self.types_at(left.select(*KEY, "namespace", "name", _none("qualifier")).unionByName(dotted)), "named-types")
        waiting = written(behind.join(own.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "target", "name", "n_args", "namespace"), "waiting")
        follows, lambdas = self._edges(local)
        new = values.add(self._first_values(local, inner, named).distinct())
        extra, extends, round_ = None, not self.extensions.isEmpty(), 0
        far = written(self.extended(waiting), "extensions") if extends else None
        while True:
            round_ += 1
            # 1. Names behind what the last round typed; or, where it typed nothing, what was chosen below.
            if extra is None:
                found = self.nearest(waiting.join(new.select("doc_id", F.col("at").alias("target"), "type_id"), ["doc_id", "target"]), far)
            else:
                found = extra.withColumn("n", F.lit(1).cast("long"))
            found = candidates.add(found.withColumn("round", F.lit(round_))).filter(sure)
            # 2. The values that follow: of these names, behind what was typed, and of parameters of lambdas in calls that are bound now.
            texts = [self._following(follows, new)] if extra is None else []
            if lambdas is not None:
                texts.append(self._lambda_values(lambdas, found.unionByName(inner) if round_ == 1 else found))
            step = self.member_values(found)
            if texts:
                step = step.unionByName(self.typed(reduce(DataFrame.unionByName, texts), "doc_id", "at"))
            new = values.add(step.join(values.table().select("doc_id", "at"), ["doc_id", "at"], "left_anti").distinct())
            extra = None
            if not new.isEmpty():
                continue
            # Nothing follows any more: overloads by the types of arguments, of nested calls the inner ones first.
            known = candidates.table().drop("round")
            done = known.filter(sure).select(*KEY).distinct()
            pending = written(known.filter(f"not ({sure})").drop("n").join(done, KEY, "left_anti").distinct(), "pending")
            if not pending.isEmpty():
                extra = self.better_overloads(self.ready(pending, values.table()), values.table())
                continue
            if not extends:
                break
            # Extension methods behind receivers of unknown type; of a chain of them, the first one first.
            loose = waiting.join(done, KEY, "left_anti").join(named.filter("whole").select(*KEY), KEY, "left_anti")
            some = written(far.join(loose.select(*KEY), KEY, "left_semi"), "loose")
            if some.isEmpty():
                break
            later = loose.join(some.select("doc_id", F.col("start").alias("target")).distinct(), ["doc_id", "target"]).select(*KEY)
            extra = written(some.join(later, KEY, "left_anti"), "loose")
            if extra.isEmpty():
                break
        bound = candidates.table().filter(sure)
        return self._references(local, bound.select(*KEY, "symbol_id"), named), self._inferred_texts(values.table(), bound)

    def _first_values(self, local: DataFrame, inner: DataFrame, named: DataFrame) -> DataFrame:
        """Values that no other expression decides."""
        known = self.locals.filter("given_type is not null").select("symbol_id", plain_type(F.col("given_type")).alias("type_text"), "node_kind")
        used = local.select(*KEY, "symbol_id", "namespace", "n_args").join(known, "symbol_id")
        function, called = F.col("node_kind") == "LocalFunctionStatement", F.col("n_args").isNotNull()
        unknown, no = self._unknown_type, F.lit(False).alias("delegate")
        here = [F.col("doc_id").alias("ctx_doc"), F.col("namespace").alias("ctx_space"), *unknown]
        used = used.filter((function == called) | ~function).select("doc_id", F.col("start").alias("at"), "type_text", *here, (~function & called).alias("delegate"))
        static = named.join(self.indexers.withColumnsRenamed({"type_id": "symbol_id", "indexer": "own_indexer"}), "symbol_id", "left")
        static = static.select("doc_id", F.col("start").alias("at"), _none("type_text"), _none("ctx_doc"), _none("ctx_space"), F.col("symbol_id").alias("type_id"), "own_indexer", no)
        own = self.others.filter("type_text is not null").select("doc_id", "at", plain_type(F.col("type_text")).alias("type_text"), *here, no)
        inside = self.others.filter("own_type is not null").select("doc_id", "at", F.col("own_type").alias("of")).join(self.indexers.withColumnRenamed("type_id", "of"), "of")
        inside = inside.select("doc_id", "at", F.col("indexer.held").alias("type_text"), "indexer.ctx_doc", "indexer.ctx_space", *unknown, no)
        return self.member_values(inner).unionByName(self.typed(used.unionByName(static).unionByName(own).unionByName(inside), "doc_id", "at"))

    @property
    def _unknown_type(self) -> list[Column]:
        return [_none("type_id"), F.lit(None).cast(self.indexers.schema["indexer"].dataType).alias("own_indexer")]

    @property
    def _unknown(self) -> DataFrame:
        """Variables without a written type, with the place that tells it; parameters of lambdas with their place ``i`` in the call and ``k`` in the lambda."""
        place = F.split("of_lambda", ":")
        return self.locals.filter("given_type is null and target is not null").select(
            "doc_id", "symbol_id", "target", "is_element", "of_lambda", place[0].cast("int").alias("i"), place[1].cast("int").alias("k")
        )

    def _edges(self, local: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Where values lead: ``(doc_id, target, at, how, delegate)``, and ``(doc_id, start, i, k, behind, at, delegate)`` of lambdas in calls, None without any.

        ``how`` is ``value`` or ``held`` at uses of a variable that is or runs through the target, and else the kind of the expression.
        """
        uses = self._unknown.join(local.select("symbol_id", F.col("start").alias("at"), F.col("n_args").isNotNull().alias("delegate")), "symbol_id")
        uses = written(uses, "uses")
        own = uses.filter("of_lambda is null").select("doc_id", "target", "at", F.when(F.col("is_element"), "held").otherwise("value").alias("how"), "delegate")
        others = self.others.filter("type_text is null and target is not null").select("doc_id", "target", "at", F.col("kind").alias("how"), F.lit(False).alias("delegate"))
        asked = uses.filter("of_lambda is not null").select("doc_id", F.col("target").alias("start"), "i", "k", "at", "delegate")
        lambdas = written(asked.join(self.sites.select(*KEY, F.col("receiver").isNotNull().alias("behind")), KEY), "lambdas")
        return written(others.unionByName(own), "follows"), None if lambdas.isEmpty() else lambdas

    @staticmethod
    def _held() -> Column:
        """What a loop over a value gives; a collection of several type arguments is left alone."""
        return F.when((F.size("arguments") <= 1) | F.col("type_text").endswith("]"), F.col("element"))

    def _following(self, follows: DataFrame, new: DataFrame) -> DataFrame:
        """Texts at uses of variables, elements and awaited results of the last round's values; a declared type's indexer tells its elements."""
        rows = follows.join(new.withColumnRenamed("at", "target"), ["doc_id", "target"])
        how, same = F.col("how"), F.col("how") == "value"
        indexed = F.col("indexer").isNotNull() & (how == "ElementAccessExpression")
        awaited = F.when(F.size("arguments") == 1, F.get("arguments", F.lit(0)))
        text = F.when(same, F.col("type_text")).when(how == "held", self._held()).when(indexed, F.col("indexer.held")).when(how == "AwaitExpression", awaited).otherwise(F.col("element"))
        of = lambda c: F.when(indexed, F.col(f"indexer.{c}")).otherwise(F.col(c)).alias(c)
        kept = [F.when(same, F.col("type_id")).alias("type_id"), F.when(same, F.col("indexer")).alias("own_indexer")]
        return rows.select("doc_id", "at", text.alias("type_text"), of("ctx_doc"), of("ctx_space"), *kept, "delegate")

    def _handed(self, asked: DataFrame, calls: DataFrame) -> DataFrame:
        """Rows (doc_id, start, i, k, behind, ...) of parameters of lambdas with the type argument of the same number, in the type of the bound call's parameter."""
        hit = asked.join(calls, KEY).join(self.parameters.withColumnRenamed("i", "j"), "symbol_id")
        hit = hit.filter(F.col("j") == F.col("i") + (F.col("is_extension") & F.col("behind")).cast("int"))
        return hit.withColumn("type_text", F.get("arguments", F.col("k")))

    def _lambda_values(self, lambdas: DataFrame, calls: DataFrame) -> DataFrame:
        return self._handed(lambdas, calls.select(*KEY, "symbol_id")).select("doc_id", "at", "type_text", "ctx_doc", "ctx_space", *self._unknown_type, "delegate")

    def _inferred_texts(self, values: DataFrame, bound: DataFrame) -> DataFrame:
        """``(symbol_id, inferred)``: the type of each variable that could be told, the first of several; of a lambda's, as the call was bound first."""
        told = self._unknown.filter("of_lambda is null").join(values.withColumnRenamed("at", "target"), ["doc_id", "target"]).join(self.types.select("type_id", "name"), "type_id", "left")
        text = F.when(F.col("is_element"), self._held()).otherwise(F.coalesce("type_text", "name"))
        told = told.select("symbol_id", F.lit(1).alias("round"), text.alias("text"))
        behind = self.sites.select(*KEY, F.col("receiver").isNotNull().alias("behind"))
        asked = self._unknown.filter("of_lambda is not null").select("doc_id", F.col("symbol_id").alias("variable"), F.col("target").alias("start"), "i", "k").join(behind, KEY)
        handed = self._handed(asked, bound.select(*KEY, "symbol_id", "round")).select(F.col("variable").alias("symbol_id"), "round", F.col("type_text").alias("text"))
        out = told.unionByName(handed).filter("text is not null").groupBy("symbol_id").agg(F.min(F.struct("round", "text")).alias("x"))
        return out.select("symbol_id", F.col("x.text").alias("inferred"))

    def _references(self, local: DataFrame, bound: DataFrame, named: DataFrame) -> DataFrame:
        """All bound sites with the number of declarations that each may mean."""
        place = ("length", "line", "column", "end_line", "end_column")
        kinds = lambda rows, kind: rows.select(*KEY, "symbol_id", F.lit(kind).alias("symbol_kind"))
        # A name behind names that is a member's isn't a type's.
        types = named.join(bound.select(*KEY).distinct(), KEY, "left_anti")
        used = kinds(local, "local").unionByName(kinds(bound, "member")).unionByName(kinds(types, "type")).distinct()
        used = used.withColumn("n_candidates", F.count("*").over(Window.partitionBy(*KEY))).join(self.sites.select(*KEY, *place), KEY)
        return used.select("symbol_id", "symbol_kind", *KEY, *place, F.lit(False).alias("is_definition"), "n_candidates")
