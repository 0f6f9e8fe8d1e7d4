"""Closed loops of organisations that share people: all of three, and the strongest of three or four for a report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import corners
from quillgraph.plans.graph import few
from quillgraph.plans.ranks import numbered
from quillgraph.plans.staging import Staging

#: Ties between two blocks of organisations, about; blocks at least.
BLOCK_TIES, LEAST_BLOCKS = 250_000, 3
#: Open loops with which a search for the strongest begins; those made at most in one step; those of the first and of a later run of names.
FIRST_OPEN, MOST_OPEN, FIRST_RUN, NEXT_RUN = 50_000, 20_000_000, 100_000, 10_000_000


def _tied(projection: DataFrame) -> DataFrame:
    """(a, b, n): organisation pairs and the number of people they share."""
    return projection.select("a", "b", "person").repartition("a", "b").groupBy("a", "b", "person").agg(F.lit(1).alias("x")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def closed_triangles(projection: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, c, people): loops of three organisations a < b < c over (a, b, person), with two people or more; with
    ``most`` the first so many by people, then by name.

    A person of two sides of a loop has seats at all its corners, so is on the third side too: with t such people, the sides'
    numbers of people less 2 t are the loop's people. Organisations are dealt into blocks, and ties go to the triples of blocks
    that hold both their ends: loops close inside a triple, and open ones, far more, are neither shuffled nor sorted."""
    if most is not None:
        loop = F.col("loop")
        return _strongest(projection, 3, most).select(loop[0].alias("a"), loop[1].alias("b"), loop[2].alias("c"), "people")
    st = Staging(projection.sparkSession, "triangles")
    pairs = st.write(projection.select("a", "b", "person"), "pairs")
    ties = st.write(_tied(pairs), "ties")
    blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(ties.count() / BLOCK_TIES)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    near = (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).cast("long").alias("near")
    ids = ties.select(F.col("a").alias("id")).union(ties.select("b")).distinct()
    nodes = st.write(ids.select("id", block).select("id", "block", near), "nodes")
    code = few(nodes.select("id", (F.shiftleft(F.col("block").cast("long"), 32) + F.col("near")).alias("code")))
    coded = lambda df: df.join(code.select(F.col("id").alias("a"), F.col("code").alias("x")), "a").join(code.select(F.col("id").alias("b"), F.col("code").alias("y")), "b")
    tie = coded(ties).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n").mapInArrow(corners.pack_ties, corners.ROW)
    held = coded(pairs).groupBy("person").agg(F.array_sort(F.array_union(F.collect_set("x"), F.collect_set("y"))).alias("orgs"))
    corner = held.where(F.size("orgs") > 2).select("orgs").mapInArrow(corners.pack_corners, corners.ROW)
    name = nodes.select("block", "near", "id").mapInArrow(corners.pack_names, corners.ROW)
    packed = st.write(tie.union(corner).union(name), "packed")
    st.drop(pairs, ties, nodes)

    other = lambda least: F.explode(F.sequence(least, F.lit(blocks - 1)))
    tie = packed.where("kind = 'ties'").withColumn("o", other(F.lit(0))).withColumn("of", F.array_sort(F.array("i", "j", "o")))
    corner = packed.where("kind = 'corners'").withColumn("o", F.lit(0)).withColumn("of", F.array("i", "j", "k"))
    name = packed.where("kind = 'names'").withColumn("p", other(F.lit(0))).withColumn("o", other(F.col("p"))).withColumn("of", F.array_sort(F.array("i", "p", "o"))).drop("p")
    # Triples of blocks are numbered without gaps, as ``corners.triple`` reads them.
    x, y, z = (F.col("of")[v].cast("long") for v in range(3))
    part = F.expr("cast((z * (z + 1) * (z + 2)) div 6 + (y * (y + 1)) div 2 + x as int)")
    rows = tie.union(corner).union(name).withColumns({"x": x, "y": y, "z": z}).select(part.alias("part"), "kind", "i", "j", "k", "one", "two", "value")
    return rows.repartitionById(math.comb(blocks + 2, 3), F.col("part")).mapInArrow(corners.close, corners.LOOPS)


def _sides(length: int) -> list[Column]:
    at = lambda i: F.col("loop")[i % length]
    return [F.struct(F.least(at(i), at(i + 1)).alias("a"), F.greatest(at(i), at(i + 1)).alias("b")) for i in range(length)]


def _with_people(loops: DataFrame, pairs: DataFrame, length: int, st: Staging | None = None) -> DataFrame:
    """(orgs, loop, people): the distinct people on the sides of each (loop), two or more; per set of organisations its best loop."""
    sides = loops.select("loop", F.explode(F.array(*_sides(length))).alias("s")).select("loop", "s.*")
    if st is not None:
        # The sides are looked up before their people are shuffled.
        pairs = st.write(pairs.join(few(st.write(sides.select("a", "b").distinct(), "sides")), ["a", "b"], "left_semi"), "people")
    people = sides.join(pairs.select("a", "b", "person"), ["a", "b"]).groupBy("loop").agg(F.countDistinct("person").alias("people")).where("people >= 2")
    orgs = F.array_join(F.array_sort("loop"), ",")
    return people.groupBy(orgs.alias("orgs")).agg(F.max(F.struct("people", "loop")).alias("best")).select("orgs", "best.loop", "best.people")


def _canonical(ends: list[str]) -> Column:
    """The loop in its one form: of three by name; of four from the least, the lesser of its neighbours next."""
    c = [F.col(x) for x in ends]
    if len(c) == 3:
        return F.array_sort(F.array(*c))
    turn = lambda i: F.array(c[i], F.least(c[i - 1], c[(i + 1) % 4]), c[(i + 2) % 4], F.greatest(c[i - 1], c[(i + 1) % 4]))
    least = F.least(*c)
    return F.when(c[0] == least, turn(0)).when(c[1] == least, turn(1)).when(c[2] == least, turn(2)).otherwise(turn(3))


def _all_squares(ties: DataFrame) -> DataFrame:
    """(loop) of all loops of four, from open ones b - a - d with b < d that meet on b and d."""
    both = ties.select(F.col("a").alias("x"), F.col("b").alias("y")).union(ties.select("b", "a"))
    open_ = both.select(F.col("x").alias("m"), F.col("y").alias("b")).join(both.select(F.col("x").alias("m"), F.col("y").alias("d")), "m").where("b < d")
    meet = open_.where("m < b").withColumnRenamed("m", "a").join(open_.withColumnRenamed("m", "c"), ["b", "d"]).where("a < c")
    return meet.select(F.array("a", "b", "c", "d").alias("loop"))


class _Search:
    """The first ``most`` loops of a length by people, then by name.

    A loop has at most as many people as its ties together, its strength. Loops of a strength and beyond hold all that have
    so many people, so the strengths are gone down until enough loops have as many people as the strength reached."""

    def __init__(self, projection: DataFrame, length: int, most: int):
        self.length, self.most = length, most
        self.st = Staging(projection.sparkSession, "strongest")
        self.pairs = self.st.write(projection.select("a", "b", "person"), "pairs")
        self.ties = self.st.write(_tied(self.pairs), "ties")
        self.both = self.ties.select(F.col("a").alias("p"), F.col("b").alias("q"), "n").union(self.ties.select("b", "a", "n"))
        # How many ties of each number of people an organisation has.
        self.kinds = self.st.write(self.both.groupBy(F.col("p").alias("q"), F.col("n").alias("m")).agg(F.count(F.lit(1)).alias("k")), "kinds")

    def open_bound(self) -> str:
        """A loop without its weakest tie has a tie x at one end that is no weaker than the other end, and y beside it: what its strength can be."""
        return "n + 2 * m" if self.length == 3 else "2 * n + m + least(n, m)"

    def reached(self) -> list[tuple[int, int]]:
        """(strength, open loops) of all strengths that open loops can reach, from the greatest."""
        one = self.kinds.select("q", F.col("m").alias("n"), F.col("k").alias("k1"))
        on = one.join(self.kinds, "q").where("m <= n" if self.length == 3 else "true").groupBy(F.expr(self.open_bound()).alias("s"))
        return [(r["s"], r["open"]) for r in on.agg(F.sum(F.expr("k1 * k")).alias("open")).orderBy(F.desc("s")).collect()]

    def _small(self, df: DataFrame, name: str) -> DataFrame:
        return few(self.st.write(df, name))

    def beyond(self, strength: int) -> DataFrame | None:
        """(loop) of that strength or more, each once; None where too many open loops would be made."""
        to = self.both.select(F.col("p").alias("q"), F.col("q").alias("r"), F.col("n").alias("m"))
        first = self.both.join(few(self.kinds), "q").where(f"{self.open_bound()} >= {strength}" + (" and m <= n" if self.length == 3 else ""))
        first = self._small(first.select("p", "q", "n", "m"), "first")
        path = to.join(first, ["q", "m"]).where("r <> p")
        last = self.ties.select("a", "b", F.col("n").alias("w"))
        if self.length == 3:
            path = self._small(path.select("p", "q", "r", "m", F.expr("n + m").alias("sum"), F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b")), "open")
            found = last.join(path, ["a", "b"]).where(f"w <= m and sum + w >= {strength}")
            return found.select(_canonical(["p", "q", "r"]).alias("loop")).distinct()
        path = self.st.write(path.select("p", "q", "r", "n", "m"), "open")
        kinds = self.kinds.select(F.col("q").alias("r"), F.col("m").alias("z"), "k")
        path = path.join(few(kinds), "r").where(f"z <= n and n + m + z + least(m, z) >= {strength}")
        if (path.agg(F.sum("k")).first()[0] or 0) > MOST_OPEN:
            return None
        path = self._small(path.select("p", "q", "r", "z", F.expr("n + m + z").alias("sum"), F.least("m", "z").alias("least")), "kinds")
        path = self.both.select(F.col("p").alias("r"), F.col("q").alias("s"), F.col("n").alias("z")).join(path, ["r", "z"]).where("s <> p and s <> q")
        path = self._small(path.select("p", "q", "r", "s", "sum", F.col("least"), F.least("p", "s").alias("a"), F.greatest("p", "s").alias("b")), "open")
        found = last.join(path, ["a", "b"]).where(f"w <= least and sum + w >= {strength}")
        return found.select(_canonical(["p", "q", "r", "s"]).alias("loop")).distinct()

    def named(self, strength: int, run: DataFrame) -> DataFrame:
        """(loop) of that strength or more whose least organisation is in ``run`` (a)."""
        # first: ties from the least organisation, second: on to an organisation beyond it.
        first = self.ties.join(run, "a", "left_semi").select("a", F.col("b").alias("q"), "n")
        to = self.both.select(F.col("p").alias("q"), F.col("q").alias("c"), F.col("n").alias("m"))
        open_ = first.join(to, "q").where("a < c")
        if self.length == 3:
            third = self.ties.select("a", F.col("b").alias("c"), F.col("n").alias("w")).join(run, "a", "left_semi")
            return open_.where("q < c").join(third, ["a", "c"]).where(f"n + m + w >= {strength}").select(F.array("a", "q", "c").alias("loop"))
        top = few(self.kinds.groupBy("q").agg(F.max("m").alias("top")))
        open_ = open_.join(top.select(F.col("q").alias("a"), F.col("top").alias("ta")), "a").join(top.select(F.col("q").alias("c"), F.col("top").alias("tc")), "c")
        open_ = open_.where(f"n + m + ta + tc >= {strength}").select("a", "q", "c", F.expr("n + m").alias("w"))
        meet = open_.select("a", "c", F.col("q").alias("b"), "w").join(open_.select("a", "c", F.col("q").alias("d"), F.col("w").alias("v")), ["a", "c"])
        return meet.where(f"b < d and w + v >= {strength}").select(F.array("a", "b", "c", "d").alias("loop"))

    def best(self, loops: DataFrame, strength: int, also: DataFrame | None = None) -> tuple[DataFrame, int, int | None, str | None]:
        """The first loops, how many of them have as many people as the strength, and people and name of the last if there are enough."""
        out = _with_people(self.st.write(loops, "loops"), self.pairs, self.length, self.st)
        if also is not None:
            out = out.union(also).groupBy("orgs").agg(F.max(F.struct("people", "loop")).alias("best")).select("orgs", "best.loop", "best.people")
        out = self.st.write(out.orderBy(F.desc("people"), "orgs").limit(self.most), "best")
        rows = out.select("people", "orgs").collect()
        reach = [r for r in rows if r["people"] >= strength]
        last = min(rows, key=lambda r: r["people"])["people"] if len(rows) == self.most else None
        name = max((r["orgs"].encode() for r in reach if r["people"] == strength), default=b"") if len(reach) == self.most else None
        return out, len(reach), last, name

    def by_name(self, strength: int, found: DataFrame | None) -> tuple[DataFrame | None, bool]:
        """``found``, which holds the first loops beyond this strength, with those of this strength: their least organisations
        are taken run by run in the order of names, until no later one can belong to the result."""
        degree = self.kinds.groupBy("q").agg(F.sum("k").alias("d"))
        names = self.ties.join(few(degree.withColumnRenamed("q", "b")), "b").groupBy("a").agg(F.sum("d").alias("open"))
        names = self.st.write(numbered(names.withColumn("key", F.concat("a", F.lit(","))), "key"), "names")
        n, total = names.agg(F.count(F.lit(1)), F.sum("open")).first()
        done, most = 0, FIRST_RUN
        while done < n:
            upto = done + max(1, n * most // total)
            run = names.where(f"rank > {done} and rank <= {upto}").select("a")
            found, have, _, last = self.best(self.named(strength, few(run, min(n, upto - done))), strength, found)
            after = names.where(f"rank > {upto}").agg(F.min("key")).first()[0]
            if have == self.most and (after is None or last < after.encode()):
                return found, True
            done, most = upto, min(NEXT_RUN, 4 * most)
        return found, False

    def run(self) -> DataFrame | None:
        levels = self.reached()
        if not levels:
            return None
        made = lambda s: sum(k for at, k in levels if at >= s)
        found, known, many = None, levels[0][0] + 1, FIRST_OPEN
        strength = next((s for s, _ in levels if made(s) >= FIRST_OPEN), self.length)
        while True:
            loops = self.beyond(strength) if made(strength) <= MOST_OPEN else None
            if loops is not None:
                found, have, last, _ = self.best(loops, strength)
                if have == self.most or strength <= self.length:
                    return found
                known, many = strength, 4 * max(many, made(strength))
                # The people of the last so far, or the next strength that needs a few times as many open loops.
                next_ = next((s for s, _ in levels if s < known and made(s) >= many), self.length)
                strength = max(min(next_, known - 1), self.length, last or 0)
            elif strength < known - 1:
                strength = known - 1
            else:
                found, enough = self.by_name(strength, found)
                if enough or strength <= self.length:
                    return found
                known, strength = strength, strength - 1


def _strongest(projection: DataFrame, length: int, most: int) -> DataFrame:
    """(orgs, loop, people) of the first ``most`` loops of three or four organisations; see ``_Search``."""
    found = _Search(projection, length, most).run()
    if found is None:
        return projection.sparkSession.createDataFrame([], "orgs string, loop array<string>, people long")
    return found.orderBy(F.desc("people"), "orgs")


def closed_squares(projection: DataFrame, most: int | None = None) -> DataFrame:
    """(orgs, people): loops of four organisations, one per set, with the people of its best loop, two or more. With
    ``most``, the first so many by people, then by name; only loops that can be among them are made, and none of them is lost."""
    if most is not None:
        return _strongest(projection, 4, most).select("orgs", "people")
    return _with_people(_all_squares(_tied(projection)), projection, 4).select("orgs", "people")


def loop_report(projection: DataFrame, most: int = 200) -> DataFrame:
    """(orgs, length, people): the first ``most`` loops, shorter ones first, then by people, then by name. Loops of four,
    by far the dearer, are only looked for where those of three are too few."""
    three = closed_triangles(projection, most).select(F.concat_ws(",", "a", "b", "c").alias("orgs"), F.lit(3).alias("length"), "people")
    order = ("length", F.desc("people"), "orgs")
    if three.count() == most:
        return three.orderBy(*order)
    return three.unionByName(closed_squares(projection, most).select("orgs", F.lit(4).alias("length"), "people")).orderBy(*order).limit(most)
