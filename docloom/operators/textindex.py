"""A positional inverted index: postings (term, id, pos) as a DataFrame.

Positions are places among the *kept* tokens, so stop words don't count towards
phrases and distances. Ids are compared, joined and aggregated as columns; the
few terms of a query come from the driver."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TextConfig
from ..sources.files import Files
from ..sources.spread import segments


@dataclass(frozen=True)
class TextIndex:
    name: str
    postings: DataFrame
    config: TextConfig = field(default_factory=TextConfig)
    #: (id, tokens), if the index isn't a stored one: counts documents unexploded.
    tokens: DataFrame | None = None
    #: Documents with a term, if that is known.
    documents: int | None = None
    #: (id, text), if the index isn't a stored one: saving spreads the texts.
    texts: DataFrame | None = None

    @classmethod
    def build(cls, df: DataFrame, name: str, id_: str = "id", config: TextConfig | None = None) -> TextIndex:
        config = config or TextConfig()
        return cls._of_texts(df.select(F.col(id_).alias("id"), F.col(name).alias("text")), name, config)

    @classmethod
    def _of_texts(cls, texts: DataFrame, name: str, config: TextConfig) -> TextIndex:
        tokens = texts.select("id", config.column(F.col("text")).alias("tokens"))
        # the outer form: for the inner one Catalyst infers filters that tokenise twice more
        postings = tokens.select("id", F.posexplode_outer("tokens").alias("pos", "term")).filter("term is not null")
        return cls(name, postings.select("term", "id", "pos"), config, tokens, texts=texts)

    def _of(self, terms: Sequence[str]) -> DataFrame:
        return self.postings.filter(F.col("term").isin(*terms))

    def _none(self) -> DataFrame:
        return self.postings.select("id").filter(F.lit(False))

    def search(self, text: str) -> DataFrame:
        """Ids that have all tokens of ``text``."""
        return self._all(self.config.tokens(text))

    def search_all(self, terms: Sequence[str]) -> DataFrame:
        """``terms`` are folded, but not split."""
        return self._all([self.config.fold(t) for t in terms])

    def _all(self, terms: Sequence[str]) -> DataFrame:
        terms = list(dict.fromkeys(terms))
        if not terms:
            return self._none()
        if len(terms) == 1:
            return self._of(terms).select("id").distinct()
        return self._of(terms).groupBy("id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(terms)).select("id")

    def search_any(self, terms: Sequence[str]) -> DataFrame:
        terms = [self.config.fold(t) for t in terms]
        return self._of(terms).select("id").distinct() if terms else self._none()

    def search_prefix(self, prefix: str) -> DataFrame:
        if not prefix:
            return self._none()
        return self.postings.filter(F.col("term").startswith(self.config.fold(prefix))).select("id").distinct()

    def search_phrase(self, phrase: str) -> DataFrame:
        """Every hit votes for where the phrase would begin; a start with a vote
        for each of its places is one."""
        terms = self.config.tokens(phrase)
        if not terms:
            return self._none()
        places: dict[str, list[int]] = {}
        for k, t in enumerate(terms):
            places.setdefault(t, []).append(k)
        votes = F.create_map(*[x for t, ks in places.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
        hits = self._of(list(places)).select("id", "pos", F.explode(votes[F.col("term")]).alias("k"))
        return hits.groupBy("id", (F.col("pos") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("n")).filter(F.col("n") == len(terms)).select("id").distinct()

    def search_near(self, terms: Sequence[str], distance: int) -> DataFrame:
        """All terms, the last at most ``distance`` after the first. For each
        hit, the latest position of every term so far; the earliest of them
        tells whether a window ends here. One sorted pass per document."""
        terms = list(dict.fromkeys(self.config.fold(t) for t in terms))
        if len(terms) < 2:
            return self.search_all(terms)
        so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        latest = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(so_far) for t in terms]
        hits = self._of(terms).select("id", "pos", F.array(*latest).alias("latest"))
        whole = F.forall("latest", lambda x: x.isNotNull())
        return hits.filter(whole & (F.col("pos") - F.array_min("latest") <= distance)).select("id").distinct()

    def ranked(self, text: str) -> DataFrame:
        """(id, score): sum over the query's tokens of (1 + log2 tf) * idf, where
        idf = log2(N / df) within 0 and 100; best first, ties by id."""
        weights = Counter(self.config.tokens(text))
        if not weights:
            return self.postings.select("id", F.lit(0.0).alias("score")).filter(F.lit(False))
        times = F.create_map(*[F.lit(x) for t, n in weights.items() for x in (t, n)])
        tf = self._of(list(weights)).groupBy("term", "id").agg(F.count("*").alias("tf"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        total = self._total()
        rows = tf.join(F.broadcast(df), "term")  # a row per query term
        idf = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.log2(total / F.col("df"))))
        score = F.sum(times[F.col("term")] * (1 + F.log2("tf")) * idf)
        return rows.groupBy("id").agg(score.alias("score")).orderBy(F.desc("score"), "id")

    def _total(self) -> Column:
        if self.documents is not None:
            return F.lit(self.documents)
        some = self.postings if self.tokens is None else self.tokens.filter(F.size("tokens") > 0)
        return some.agg(F.count_distinct("id")).scalar()

    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count_distinct("id").alias("df"), F.count("*").alias("cf"))

    def statistics(self) -> DataFrame:
        return self.postings.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("entries"), F.count_distinct("id").alias("documents"))

    def save(self, path: str) -> None:
        """Segments of documents, and a card with the configuration and the
        number of documents. Postings outweigh the texts, so the texts are
        spread; each task tokenises its own, once, and writes their postings in
        the order of terms: a term's pages are found in every file by their
        limits."""
        spark = self.postings.sparkSession
        postings = self.postings if self.texts is None else self._of_texts(segments(self.texts), self.name, self.config).postings
        postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        documents = self.documents
        if documents is None:
            stored = spark.read.parquet(f"{path}/postings")
            # of tokenised texts, those with a term have one at 0
            some = stored if self.tokens is None else stored.filter("pos = 0")
            documents = some.agg(F.count_distinct("id")).first()[0]
        files = Files(spark)
        files.delete(f"{path}/card.json")
        files.create(f"{path}/card.json", json.dumps({"config": asdict(self.config), "documents": documents}))

    @classmethod
    def load(cls, spark: SparkSession, path: str, name: str, config: TextConfig | None = None) -> TextIndex:
        """With the configuration it was built with, unless another is given."""
        card = json.loads(Files(spark).read(f"{path}/card.json"))
        kept = card["config"] | {"stop_words": tuple(card["config"]["stop_words"])}
        return cls(name, spark.read.parquet(f"{path}/postings"), config or TextConfig(**kept), documents=card["documents"])
