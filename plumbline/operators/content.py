"""Content models of elements as deterministic automata, and the validation of whole packages.

A declaration says which children an element may have: particles in sequence or by choice, each so many
times. compiled() turns declarations into automata, a table with one row for each model: its transitions,
the states that may end, and what is expected in each state. check() joins elements to their models and
folds each element's ordered children through the transitions; there is no function of Python in it.

Which part is validated by which model is a join on (content type, root element); there is no other
way to find one. A package was validated if all its relevant parts were, and is valid if, besides,
nothing is wrong in them and the slides have their size.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a model's automaton at most; beyond it a declaration repeats too much to be compiled.
MOST_STATES = 5000
#: Fixed value: width and height of a slide in EMU.
SLIDE_SIZE = (12_192_000, 6_858_000)
MODELS = "model string, transitions map<string,int>, final array<int>, expected array<string>, attributes array<string>, required array<string>"


@dataclass(frozen=True)
class Particle:
    """name: of a child; else parts, all in order or (choice) one of them. least to most times; most None: any number."""

    name: str | None = None
    parts: tuple[Particle, ...] = ()
    choice: bool = False
    least: int = 1
    most: int | None = 1


def child(name: str, least: int = 1, most: int | None = 1) -> Particle:
    return Particle(name, (), False, least, most)


def sequence(*parts: Particle, least: int = 1, most: int | None = 1) -> Particle:
    return Particle(None, parts, False, least, most)


def choice(*parts: Particle, least: int = 1, most: int | None = 1) -> Particle:
    return Particle(None, parts, True, least, most)


@dataclass(frozen=True)
class Declaration:
    """What an element has: its children, and its attributes (True: required)."""

    content: Particle = field(default_factory=sequence)
    attributes: dict[str, bool] = field(default_factory=dict)


# Compilation: the places of names in a declaration, which may come first, last and after each other; then sets of places as states.


@dataclass
class Places:
    names: list[str] = field(default_factory=list)
    after: list[set[int]] = field(default_factory=list)

    def once(self, p: Particle) -> tuple[bool, set[int], set[int]]:
        """Whether one occurrence of a particle may be empty, and its first and last places."""
        if p.name is not None:
            if len(self.names) >= MOST_STATES:
                raise ValueError(f"a declaration has more than {MOST_STATES} places")
            self.names.append(p.name)
            self.after.append(set())
            return False, {len(self.names) - 1}, {len(self.names) - 1}
        found = [self.repeated(part) for part in p.parts]
        if p.choice:
            return any(e for e, _, _ in found), set().union(*(f for _, f, _ in found)), set().union(*(x for _, _, x in found))
        return self.joined(found)

    def joined(self, found: Iterable[tuple[bool, set[int], set[int]]]) -> tuple[bool, set[int], set[int]]:
        """One after the other."""
        empty, first, last = True, set(), set()
        for e, f, x in found:
            for place in last:
                self.after[place] |= f
            first = first | f if empty else first
            last = last | x if e else x
            empty = empty and e
        return empty, first, last

    def repeated(self, p: Particle) -> tuple[bool, set[int], set[int]]:
        copies = [self.once(p) for _ in range(p.least if p.most is None else p.most)] or ([self.once(p)] if p.most is None else [])
        copies = [(e or k >= p.least, f, x) for k, (e, f, x) in enumerate(copies)]
        if p.most is None:
            _, first, last = copies[-1]
            for place in last:
                self.after[place] |= first
        return self.joined(copies)


def automaton(content: Particle) -> tuple[dict[str, int], list[int], list[str]]:
    """Transitions by "state name", the states that may end, and for each state the names it goes on with. 0 is the first."""
    places = Places()
    empty, first, last = places.repeated(content)
    states, todo, moves, final = {None: 0}, [None], {}, []
    while todo:
        state = todo.pop()
        if empty if state is None else state & last:
            final.append(states[state])
        reach: dict[str, set[int]] = {}
        for place in first if state is None else set().union(*(places.after[p] for p in state)):
            reach.setdefault(places.names[place], set()).add(place)
        for name, to in reach.items():
            to = frozenset(to)
            if to not in states:
                if len(states) >= MOST_STATES:
                    raise ValueError(f"a declaration has more than {MOST_STATES} states")
                states[to] = len(states)
                todo.append(to)
            moves[f"{states[state]} {name}"] = states[to]
    goes_on = [sorted(k.partition(" ")[2] for k in moves if k.partition(" ")[0] == str(s)) for s in range(len(states))]
    return moves, sorted(final), [" ".join(x) for x in goes_on]


def compiled(spark: SparkSession, declarations: dict[str, Declaration]) -> DataFrame:
    """The automata of declarations, by the name of their model."""
    rows = []
    for name, d in declarations.items():
        moves, final, expected = automaton(d.content)
        rows.append((name, moves, final, expected, sorted(d.attributes), sorted(k for k, v in d.attributes.items() if v)))
    return F.broadcast(spark.createDataFrame(rows, MODELS))  # as many rows as were declared


def run(children: Column, transitions: Column) -> Column:
    """state after the children, at (children read), bad (the place of the first child that can't come there, from 1, else null)."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s, name):
        to = F.try_element_at(transitions, F.concat(s["state"].cast("string"), F.lit(" "), name))
        moved = F.struct(F.coalesce(to, s["state"]).alias("state"), (s["at"] + 1).alias("at"), F.when(to.isNull(), s["at"] + 1).alias("bad"))
        return F.when(s["bad"].isNotNull(), s).otherwise(moved)

    return F.aggregate(children, start, step)


def check(elements: DataFrame, models: DataFrame) -> DataFrame:
    """All columns of elements (with model, children array<string>, attributes map or array of names) but these three,
    and problem, place and detail of each thing wrong: an element without a declaration, the first child out of
    place, children that are missing at the end, attributes that aren't declared or are missing."""
    keep = [c for c in elements.columns if c not in ("model", "children", "attributes")]
    x = elements.join(models.select("model", "transitions", "final", "expected", F.col("attributes").alias("known"), "required", F.lit(True).alias("declared")), "model", "left")
    x = x.withColumn("end", F.when(F.col("declared"), run(F.coalesce("children", F.array()), F.col("transitions"))))
    end, kind = F.col("end"), dict(elements.dtypes)["attributes"]
    have = F.map_keys("attributes") if kind.startswith("map") else F.col("attributes")
    have = F.coalesce(have, F.array().cast("array<string>"))
    expects = F.concat(F.lit("expected "), F.when(F.element_at("expected", end["state"] + 1) == "", "nothing").otherwise(F.element_at("expected", end["state"] + 1)))
    one = lambda when, problem, at, detail: F.when(when, F.array(F.struct(F.lit(problem).alias("problem"), at.alias("place"), detail.alias("detail")))).otherwise(F.array())
    none = F.lit(None).cast("int")
    each = lambda names, problem: F.transform(F.array_sort(names), lambda a: F.struct(F.lit(problem).alias("problem"), none.alias("place"), a.alias("detail")))
    found = F.concat(
        one(F.col("declared").isNull(), "undeclared element", none, F.col("model")),
        one(end["bad"].isNotNull(), "unexpected child", end["bad"], F.concat(F.get("children", end["bad"] - 1), F.lit(", "), expects)),
        one(end["bad"].isNull() & ~F.array_contains("final", end["state"]), "missing child", end["at"] + 1, expects),
        F.coalesce(F.when(F.col("declared"), each(F.array_except(have, "known"), "undeclared attribute")), F.array()),
        F.coalesce(F.when(F.col("declared"), each(F.array_except("required", have), "missing attribute")), F.array()),
    )
    return x.select(*keep, F.explode(found).alias("_f")).select(*keep, "_f.problem", "_f.place", "_f.detail")


# Packages


def relevant(name: Column) -> Column:
    """Parts that must be validated."""
    return name.startswith("ppt/") & name.endswith(".xml") & ~name.contains("/_rels/")


def mapped(parts: DataFrame, root_map: DataFrame) -> DataFrame:
    """parts (package_id, part_name, content_type, root) with schema, by content type and root; null where the map has none."""
    return parts.join(F.broadcast(root_map.select("content_type", "root", "schema")), ["content_type", "root"], "left")  # a map is written by hand


def unmapped(parts: DataFrame) -> DataFrame:
    """Problems of relevant parts that nothing validates."""
    why = F.when(F.col("root").isNull(), "malformed XML").when(F.col("content_type").isNull(), "no content type").when(F.col("schema").isNull(), "unmapped part")
    detail = F.when(F.col("content_type").isNotNull() & F.col("root").isNotNull(), F.concat_ws(" ", "content_type", "root"))
    return parts.withColumn("problem", why).filter("problem is not null").select("package_id", "part_name", "problem", detail.alias("detail"))


def verdicts(parts: DataFrame, violations: DataFrame) -> DataFrame:
    """package_id, relevant, validated, violations, performed (all relevant parts were validated, and there are some) and valid.
    parts: of mapped(), the relevant ones and others; violations: package_id and more, a row for each."""
    n = parts.groupBy("package_id").agg(F.count_if(relevant(F.col("part_name"))).alias("relevant"), F.count_if(relevant(F.col("part_name")) & F.col("schema").isNotNull()).alias("validated"))
    wrong = violations.groupBy("package_id").agg(F.count(F.lit(1)).alias("violations"))
    x = n.join(wrong, "package_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    performed = (F.col("relevant") > 0) & (F.col("relevant") == F.col("validated"))
    return x.withColumn("performed", performed).withColumn("valid", performed & (F.col("violations") == 0))


def size_problems(elements: DataFrame, tag: str, part: str, size: tuple[int, int] = SLIDE_SIZE) -> DataFrame:
    """Packages whose part hasn't just one element with the tag, or of another size. elements: of package.elements()."""
    whole = lambda k: F.try_element_at("attributes", F.lit(k)).try_cast("long")
    mine = elements.filter(F.col("part_name") == part).groupBy("package_id").agg(F.count_if(F.col("model") == tag).alias("n"), F.max(F.when(F.col("model") == tag, F.struct(whole("cx").alias("cx"), whole("cy").alias("cy")))).alias("size"))
    right = (F.col("size.cx") == size[0]) & (F.col("size.cy") == size[1])
    why = F.when(F.col("n") != 1, F.concat(F.lit("sizes: "), F.col("n").cast("string"))).when(~F.coalesce(right, F.lit(False)), F.concat(F.lit("size: "), F.coalesce(F.concat_ws("x", "size.cx", "size.cy"), F.lit("?"))))
    return mine.withColumn("detail", why).filter("detail is not null").select("package_id", F.lit(part).alias("part_name"), F.lit("slide size").alias("problem"), "detail")


def validate(elements: DataFrame, content_types: DataFrame, root_map: DataFrame, models: DataFrame, parts: DataFrame, presentation: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(violations, verdicts) of packages. elements: package.elements(); parts: all parts by name; content_types:
    package_id, part_name, content_type; presentation: its part and the tag of the slide size, to check that."""
    roots = elements.filter(F.size("path") == 0).select("package_id", "part_name", F.col("model").alias("root"))
    mine = parts.filter(relevant(F.col("part_name"))).select("package_id", "part_name").join(content_types, ["package_id", "part_name"], "left").join(roots, ["package_id", "part_name"], "left")
    known = mapped(mine, root_map)
    todo = elements.join(known.filter("schema is not null").select("package_id", "part_name"), ["package_id", "part_name"], "left_semi")
    found = check(todo, models).select("package_id", "part_name", "problem", F.concat_ws(" ", F.concat(F.lit("/"), F.array_join(F.transform("path", lambda i: i.cast("string")), "/")), "detail").alias("detail"))
    found = found.unionByName(unmapped(known))
    if presentation:
        found = found.unionByName(size_problems(todo, presentation[1], presentation[0]))
    return found, verdicts(known, found)

