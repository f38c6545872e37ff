"""An index that takes changes: generations of new rows over a base, merged when they are read.

Every upsert or deletion writes a *generation*: tables with the new versions of the changed articles and of
what is derived from them, all bucketed by ``ord`` like the base, and ``replaced``, the tombstones: the
articles whose older versions are void. Reading takes each level without the articles that a later level
replaces. What is counted rather than listed, document frequencies, totals and suggestions, is kept as signed
*deltas*: plus the new versions, minus the old ones, whose counts are worked out again from their texts. So
the work of a change grows with the change, and nothing that was there before is written again.

``compact`` merges all generations into one. ``fold`` brings them into the base: only buckets that hold a
changed article are written anew, the files of all others stay as they are and are read on; which
table owns a bucket is part of the *state*. The state is written last, under a new version, so a job that
fails leaves the version before in force, and every session that opens the folder sees whole versions only.
Readers that hold an older version keep working, as no file is removed.

A ``LiveCorpus`` has the tables of a ``Corpus``, so all searches, facets and suggestions run on it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.operators import suggest
from broadsheet.operators.skew import sized_join
from broadsheet.plans import textindex
from broadsheet.plans.corpus import BUCKETED, Corpus, directed, narrow
from broadsheet.schemas import ARTICLE_COLUMNS, TEXT_FIELDS
from broadsheet.sources.store import Store, bucket_of, bucket_of_file

#: Up to this many tombstones, 8 bytes each, are sent to all tasks; more are joined in their buckets.
SENT_TOMBSTONES = 1 << 22
#: Up to this many articles are looked up by literal key, which opens only their buckets and row groups.
LITERAL_KEYS = 1000
STATE = "content string"
COUNTS = ["n", *[f"len_{f}" for f in TEXT_FIELDS]]
#: Tables of signed counts, with their keys and values.
DELTAS = {"term_stats": (["term", "mask"], ["n"]), "suggestions": (["suggestion"], ["score"]), "totals": ([], COUNTS)}


def summed(parts: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


class LiveCorpus(Corpus):
    """A corpus with generations. ``base`` supplies the tables that the first generation stands on; the
    generations go to ``store``, an own folder."""

    def __init__(self, base: Corpus, store: Store):
        self.base, self.store, self.spark, self.buckets = base, store, base.spark, base.buckets
        self._tables: dict[str, object] = {}
        self.state = self._last_state() or {
            "version": 0, "batch": -1, "segments": [{"prefix": "", "buckets": None}], "generations": [], "deltas": [],
        }

    # --- state ---------------------------------------------------------------------------------

    def _last_state(self) -> dict | None:
        path = self.store.location("state")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        found = self.spark.read.schema(STATE + ", version int").option("basePath", path).parquet(path)
        last = found.orderBy(F.desc("version")).first()
        return json.loads(last["content"]) if last else None

    def _commit(self, **changed) -> None:
        state = {**self.state, **changed, "version": self.state["version"] + 1}
        row = self.spark.createDataFrame([(json.dumps(state),)], STATE).coalesce(1)
        row.write.mode("overwrite").parquet(self.store.location(f"state/version={state['version']}"))
        self.state = state
        self._tables.clear()

    def refresh(self) -> None:
        """Take over the last version that another session has written."""
        self.state = self._last_state() or self.state
        self._tables.clear()

    # --- reading -------------------------------------------------------------------------------

    def _table(self, prefix: str, name: str) -> DataFrame:
        """A table of the base (no prefix), of a generation or of a folded part."""
        if not prefix:
            return getattr(self.base, name)
        full = f"{prefix}_{name}"
        if name in BUCKETED or name == "replaced":
            table = self.store.table_name(full)
            if not self.spark.catalog.tableExists(table):
                sort, parts = BUCKETED.get(name, (("ord",), ()))
                columns = self.spark.read.parquet(self.store.location(full)).drop(*parts)
                ddl = ", ".join(f"{c} {t}" for c, t in columns.dtypes) + "".join(f", {p} int" for p in parts)
                self.store.attach_bucketed(full, ddl, self.buckets, sort=sort, partition_by=parts)
            return self.spark.table(table)
        return self.spark.read.parquet(self.store.location(full))

    def _segment(self, segment: dict, name: str, only: list[int] | None = None) -> DataFrame:
        """What a segment of the base still owns of a table, or the part of that in the buckets ``only``."""
        df, owned = self._table(segment["prefix"], name), segment["buckets"]
        if owned is None and only is None:
            return df
        chosen = only if owned is None else owned if only is None else [b for b in owned if b in set(only)]
        return df.where(bucket_of_file().isin(chosen))

    def _without(self, df: DataFrame, later: list[dict]) -> DataFrame:
        """``df`` without the articles that later generations replace."""
        if not later:
            return df
        dead = reduce(DataFrame.union, [self._table(g["prefix"], "replaced").select("ord") for g in later])
        small = sum(g["replaced"] for g in later) <= SENT_TOMBSTONES
        return df.join(F.broadcast(dead) if small else dead, "ord", "left_anti")

    def _merged(self, name: str, generations: list[dict], segments: list[dict], only: list[int] | None = None) -> DataFrame:
        parts = [self._without(self._segment(s, name, only), generations) for s in segments]
        parts += [self._without(self._table(g["prefix"], name), generations[i + 1 :]) for i, g in enumerate(generations)]
        columns = parts[0].columns if name != "articles" else ["ord", *ARTICLE_COLUMNS]
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])

    def _live(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._merged(name, self.state["generations"], self.state["segments"])
        return self._tables[name]

    @property
    def articles(self) -> DataFrame:
        return self._live("articles")

    @property
    def docs(self) -> DataFrame:
        return self._live("docs")

    @property
    def postings(self) -> DataFrame:
        return self._live("postings")

    @property
    def vectors(self) -> DataFrame:
        return self._live("vectors")

    @property
    def has_vectors(self) -> bool:
        return self.base.has_vectors

    def _counted(self, name: str) -> DataFrame:
        keys, values = DELTAS[name]
        base = getattr(self.base, name)
        parts = [base] + [self._table(prefix, name) for prefix in self.state["deltas"]]
        merged = summed([p.select(*keys, *values) for p in parts], keys, values)
        return base if len(parts) == 1 else merged.where(F.col(values[0]) > 0)

    @property
    def term_stats(self) -> DataFrame:
        return self._counted("term_stats")

    @property
    def suggestions(self) -> DataFrame:
        return self._counted("suggestions")

    @property
    def completions(self) -> DataFrame:
        return suggest.completions(self.suggestions)

    @property
    def totals(self) -> dict[str, int]:
        if "totals" not in self._tables:
            parts = [self._table(prefix, "totals").select(*COUNTS) for prefix in self.state["deltas"]]
            more = summed(parts, [], COUNTS).first().asDict() if parts else dict.fromkeys(COUNTS, 0)
            self._tables["totals"] = {c: self.base.totals[c] + more[c] for c in COUNTS}
        return self._tables["totals"]

    @property
    def term_blocks(self) -> None:
        """Buckets of a live index aren't one table's, so searches read them all."""
        return None

    @property
    def edit_keys(self) -> None:
        """Not kept for changes: near terms are found by a scan of the vocabulary."""
        return None

    # --- changes -------------------------------------------------------------------------------

    def _write(self, prefix: str, name: str, df: DataFrame) -> DataFrame:
        full = f"{prefix}_{name}"
        if name in BUCKETED or name == "replaced":
            sort, parts = BUCKETED.get(name, (("ord",), ()))
            spread = df.repartition(self.buckets, "ord")
            return self.store.write_bucketed(full, spread, self.buckets, sort=sort, partition_by=parts)
        return self.store.write(full, df)

    def _of(self, df: DataFrame, ords: DataFrame, n: int) -> DataFrame:
        """The rows of ``n`` articles of a table."""
        if n <= LITERAL_KEYS:
            return df.where(F.col("ord").isin([r["ord"] for r in ords.select("ord").collect()]))
        return sized_join(df, ords.select("ord"), ["ord"], "left_semi")

    def _placed(self, ids: DataFrame, prefix: str) -> DataFrame:
        """``(id, ord, old)`` of distinct ids: the article's ``ord`` where there is one, else the next free
        numbers in order of the ids, which keeps the order of ``ord`` that of ``id`` as ids go on."""
        known = sized_join(self.docs.select("id", "ord"), ids, ["id"])
        known = self._write(prefix, "known", known)
        fresh = ids.join(known, "id", "left_anti").repartitionByRange("id").withColumn("part", F.spark_partition_id())
        fresh = self._write(prefix, "fresh", fresh)
        counts = {r["part"]: r["n"] for r in fresh.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        last = self.docs.agg(F.max("ord").alias("m")).first()["m"] if counts else 0
        first, starts = (last if last is not None else -1) + 1, []
        for part in sorted(counts):
            starts.append((part, first))
            first += counts[part]
        # One row per task that wrote new ids.
        begin = F.broadcast(self.spark.createDataFrame(starts, "part int, start long"))
        inside = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
        numbered = fresh.join(begin, "part").select("id", (F.col("start") + inside).alias("ord"))
        return known.select("id", "ord", F.lit(True).alias("old")).unionByName(numbered.withColumn("old", F.lit(False)))

    def _signed(self, name: str, new: DataFrame, old: DataFrame) -> DataFrame:
        keys, values = DELTAS[name]
        minus = old.select(*keys, *[(-F.col(v)).alias(v) for v in values])
        out = summed([new.select(*keys, *values), minus], keys, values)
        return out if not keys else out.where(F.col(values[0]) != 0)

    def _change(self, prefix: str, articles: DataFrame, old: DataFrame, replaced: DataFrame, vectors, batch: int) -> None:
        """Write a generation: ``articles`` instead of ``old``, which are the live versions of ``replaced``."""
        articles = self._write(prefix, "articles", articles.select("ord", *ARTICLE_COLUMNS))
        replaced = self._write(prefix, "replaced", replaced.select("ord"))
        old = self._write(prefix, "old", old.select("ord", *ARTICLE_COLUMNS).repartition(self.buckets, "ord"))
        docs = self._write(prefix, "docs", narrow(articles))
        postings = self._write(prefix, "postings", textindex.postings(articles))
        before = self._write(prefix, "before", textindex.postings(old))
        self._write(prefix, "term_stats", self._signed("term_stats", textindex.term_stats(postings), textindex.term_stats(before)))
        self._write(prefix, "suggestions", self._signed("suggestions", suggest.dictionary(articles), suggest.dictionary(old)))
        count = lambda df, p: textindex.field_totals(p).join(df.agg(F.count(F.lit(1)).alias("n")))  # noqa: E731 - one row each
        self._write(prefix, "totals", self._signed("totals", count(articles, postings), count(old, before)))
        if self.has_vectors:
            self._write(prefix, "vectors", directed(docs, vectors))
        n = replaced.count()
        self._commit(
            generations=[*self.state["generations"], {"prefix": prefix, "replaced": n}],
            deltas=[*self.state["deltas"], prefix], batch=max(batch, self.state["batch"]),
        )

    def upsert(self, changes: DataFrame, order: str | None = None, batch: int = -1) -> None:
        """Replace or add whole articles by ``id``; within ``changes`` the highest ``order`` wins.

        ``changes`` has the article columns and may have ``vector``; without it articles keep theirs.
        ``batch`` numbers the changes of a stream: a batch that has been taken is not taken again.
        """
        if 0 <= batch <= self.state["batch"]:
            return
        prefix = f"g{self.state['version'] + 1}"
        if order:
            latest = changes.groupBy("id").agg(F.max(order).alias(order))
            changes = changes.join(latest, ["id", order], "left_semi").drop(order)
        else:
            changes = changes.dropDuplicates(["id"])
        own = ["vector"] if "vector" in changes.columns else []
        changes = self._write(prefix, "changes", changes.select(*ARTICLE_COLUMNS, *own))
        places = self._write(prefix, "places", self._placed(changes.select("id"), prefix))
        new = changes.join(places.select("id", "ord"), "id")
        n = places.count()
        old_places = places.where("old").select("ord")
        vectors = None
        if self.has_vectors:
            vectors = new.select("ord", "vector") if own else self._of(self.vectors, old_places, n).select("ord", "vector")
        self._change(prefix, new, self._of(self.articles, old_places, n), places.select("ord"), vectors, batch)

    def delete(self, ids: DataFrame) -> None:
        """Remove articles by ``id``; unknown ids have no effect."""
        prefix = f"g{self.state['version'] + 1}"
        gone = self._write(prefix, "gone", sized_join(self.docs.select("id", "ord"), ids.select("id").distinct(), ["id"]))
        none = self.articles.where(F.lit(False))
        vectors = self.vectors.where(F.lit(False)).select("ord", "vector") if self.has_vectors else None
        self._change(prefix, none, self._of(self.articles, gone, gone.count()), gone, vectors, -1)

    # --- maintenance ---------------------------------------------------------------------------

    def _keyed(self) -> list[str]:
        return [name for name in BUCKETED if name != "vectors" or self.has_vectors]

    def compact(self) -> None:
        """Merge all generations into one. The base isn't read."""
        generations = self.state["generations"]
        if len(generations) < 2:
            return
        prefix = f"c{self.state['version'] + 1}"
        for name in self._keyed():
            self._write(prefix, name, self._merged(name, generations, []))
        dead = reduce(DataFrame.union, [self._table(g["prefix"], "replaced").select("ord") for g in generations]).distinct()
        n = self._write(prefix, "replaced", dead).count()
        self._write_deltas(prefix)
        self._commit(generations=[{"prefix": prefix, "replaced": n}], deltas=[prefix])

    def _write_deltas(self, prefix: str) -> None:
        for name, (keys, values) in DELTAS.items():
            parts = [self._table(p, name).select(*keys, *values) for p in self.state["deltas"]]
            merged = summed(parts, keys, values)
            self._write(prefix, name, merged.where(F.col(values[0]) != 0) if keys else merged)

    def touched(self) -> list[int]:
        """Buckets with an article that a generation replaces; at most as many as there are buckets."""
        generations = self.state["generations"]
        if not generations:
            return []
        dead = reduce(DataFrame.union, [self._table(g["prefix"], "replaced").select("ord") for g in generations])
        rows = dead.select(bucket_of("ord", self.buckets).alias("b")).distinct().collect()
        return sorted(r["b"] for r in rows)

    def fold(self) -> list[int]:
        """Bring all generations into the base; returns the buckets that were written, no other is."""
        touched = self.touched()
        if not touched:
            return []
        prefix, state = f"f{self.state['version'] + 1}", self.state
        for name in self._keyed():
            self._write(prefix, name, self._merged(name, state["generations"], state["segments"], only=touched))
        self._write_deltas(prefix)
        every, changed = range(self.buckets), set(touched)
        segments = [
            {"prefix": s["prefix"], "buckets": [b for b in (every if s["buckets"] is None else s["buckets"]) if b not in changed]}
            for s in state["segments"]
        ]
        segments = [s for s in segments if s["buckets"]] + [{"prefix": prefix, "buckets": touched}]
        self._commit(segments=segments, generations=[], deltas=[prefix])
        return touched
