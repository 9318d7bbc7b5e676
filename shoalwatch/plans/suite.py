"""Analyses as plug-ins: primaries, secondaries on their outputs, and views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwatch.operators import coordination, hashtags, ngrams, posts
from shoalwatch.plans import automap, semantics
from shoalwatch.plans.schema import Column, Interface, Output, Param, TimeBin, resolve_params

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Analysis:
    """``run(input, params)`` gives output tables by id.

    A secondary has a ``base`` (a primary's id) and gets the base's outputs
    and those of its ``after`` instead of the input.
    """

    interface: Interface
    run: Callable[..., Tables]
    base: str | None = None
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class View:
    """A named query over the outputs of ``base``."""

    id: str
    base: str
    run: Callable[..., DataFrame]


@dataclass
class Suite:
    analyses: list[Analysis] = field(default_factory=list)
    views: list[View] = field(default_factory=list)

    def get(self, id: str) -> Analysis:
        return next(a for a in self.analyses if a.interface.id == id)

    def primaries(self, *, everything: bool = True) -> list[Analysis]:
        return [a for a in self.analyses if a.base is None and (everything or a.interface.distributed)]

    def secondaries(self, base: str) -> list[Analysis]:
        """In an order that respects ``after``; a cycle raises."""
        left = [a for a in self.analyses if a.base == base]
        done: list[Analysis] = []
        while left:
            ids = {a.interface.id for a in left}
            ready = [a for a in left if not ids & set(a.after)]
            if not ready:
                raise ValueError(f"the secondaries {sorted(ids)} depend on each other")
            done += ready
            left = [a for a in left if a not in ready]
        return done

    def views_of(self, base: str) -> list[View]:
        return [v for v in self.views if v.base == base]

    def map_columns(self, id: str, df: DataFrame) -> DataFrame:
        """Infer, map and convert the dataset's columns for a primary."""
        found = semantics.infer(df)
        inputs = self.get(id).interface.inputs
        mapping = automap.automap({c: s.type for c, s in found.items()}, inputs)
        if missing := [c.name for c in inputs if c.name not in mapping]:
            raise ValueError(f"no column fits {missing}")
        return semantics.prepare(df, mapping, found)

    def run(self, id: str, df: DataFrame, params: dict[str, Any] | None = None, *, secondary_params: dict[str, dict[str, Any]] | None = None) -> dict[str, Tables]:
        """A primary and its secondaries: tables by analysis and output.

        ``secondary_params`` has the parameters of secondaries by their id.
        """
        given = secondary_params or {}
        if unknown := given.keys() - {s.interface.id for s in self.secondaries(id)}:
            raise ValueError(f"{sorted(unknown)} are no secondaries of {id}")
        primary = self.get(id)
        values = resolve_params(primary.interface, params or {})
        out = {id: _checked(primary, primary.run(df, values))}
        for secondary in self.secondaries(id):
            own = resolve_params(secondary.interface, given.get(secondary.interface.id, {}))
            out[secondary.interface.id] = _checked(secondary, secondary.run(out, own))
        return out


def _checked(analysis: Analysis, tables: Tables) -> Tables:
    for output in analysis.interface.outputs:
        output.check(tables[output.id])
    return tables


def _columns(*names: str) -> tuple[Column, ...]:
    return tuple(Column(n, "text") for n in names)


_USER = Column("user_id", "identifier", "Author", ("author", "user", "poster", "username"))
_MESSAGE = Column("message_id", "identifier", "Message ID", ("message id", "post id", "tweet id", "id"))
_TEXT = Column("message_text", "text", "Message text", ("text", "message", "content", "body", "tweet"))
_TIME = Column("timestamp", "datetime", "Timestamp", ("timestamp", "time", "date", "created", "posted"))


def _ngrams(df: DataFrame, p: dict) -> Tables:
    t = ngrams.ngram_tables(df, min_n=p["min_n"], max_n=p["max_n"])
    return {"message_ngrams": t.message_ngrams, "ngrams": t.ngrams, "message_authors": t.message_authors}


def _ngram_stats(out: dict[str, Tables], p: dict) -> Tables:
    t = ngrams.NgramTables(**out["ngrams"])
    summary = ngrams.ngram_summary(t)
    return {"ngram_stats": summary, "ngram_full": ngrams.ngram_full_report(t, summary)}


def _hashtags(df: DataFrame, p: dict) -> Tables:
    bin_ = p["time_window"]
    return {"hashtag_analysis": hashtags.hashtag_analysis(df, text="message_text", unit=bin_.unit, amount=bin_.amount)}


DEFAULT_SUITE = Suite(
    [
        Analysis(
            Interface("character_count", "Characters per message", "1.0", (_MESSAGE, _TEXT), (Param("fudge_factor", 0, -1000, 1000),), (Output("character_count", _columns("message_id", "character_count")),)),
            lambda df, p: {"character_count": posts.character_count(df, fudge_factor=p["fudge_factor"])},
        ),
        Analysis(
            Interface("long_messages", "Long messages", "1.0", params=(Param("longer_than", 100, 0, 1_000_000),), outputs=(Output("long_messages", _columns("message_id", "character_count", "is_long")),)),
            lambda out, p: {"long_messages": posts.long_message_report(out["character_count"]["character_count"], longer_than=p["longer_than"])},
            base="character_count",
        ),
        Analysis(
            Interface("ngrams", "Repeated phrases", "1.0", (_USER, _MESSAGE, _TEXT, _TIME), (Param("min_n", 3, 1, 10), Param("max_n", 5, 1, 10)), (Output("message_ngrams", _columns("message_surrogate_id", "ngram_id"), True), Output("ngrams", _columns("ngram_id", "words", "n"), True), Output("message_authors", _columns("message_surrogate_id", "message_id", "message_text", "user_id", "timestamp"), True)), True),
            _ngrams,
        ),
        Analysis(Interface("ngram_stats", "Phrase statistics", "1.0", outputs=(Output("ngram_stats", _columns("ngram_id", "words", "n", "total_reps", "distinct_posters")), Output("ngram_full", _columns("ngram_id", "words", "user_id", "reps_per_user", "message_text")))), _ngram_stats, base="ngrams"),
        Analysis(
            Interface("time_coordination", "Co-posting users", "1.0", (_USER, _TIME), (), (Output("cooccurrence_frequency", _columns("user_id_1", "user_id_2", "cooccurrence_count")),)),
            lambda df, p: {"cooccurrence_frequency": coordination.cooccurrence(df)},
        ),
        Analysis(
            Interface("temporal", "Posts by hour", "1.0", (_TIME,), (), (Output("interval_count", _columns("count", "time_interval_start", "time_interval_end")),)),
            lambda df, p: {"interval_count": posts.temporal_profile(df)},
        ),
        Analysis(
            Interface("hashtags", "Hashtag concentration", "1.0", (_USER, _TEXT, _TIME), (Param("time_window", TimeBin("hour", 12), backfill=TimeBin("hour", 12)),), (Output("hashtag_analysis", _columns("timewindow_start", "users", "hashtags", "count", "gini", "gini_smooth")),), True),
            _hashtags,
        ),
    ],
    [
        View("length_histogram", "character_count", lambda out, **k: posts.length_histogram(out["character_count"]["character_count"], **k)),
        View("time_interval_frequencies", "temporal", lambda out, **k: posts.temporal_labels(out["temporal"]["interval_count"])),
        View("ngram_top", "ngrams", lambda out, **k: ngrams.top(out["ngram_stats"]["ngram_stats"], **k)),
        View("ngram_search", "ngrams", lambda out, **k: ngrams.search(out["ngram_stats"]["ngram_stats"], **k)),
        View("ngram_posts", "ngrams", lambda out, chosen: ngrams.posts_of(out["ngram_stats"]["ngram_full"], chosen)),
        View("ngram_scatter", "ngrams", lambda out, **k: ngrams.scatter(out["ngram_stats"]["ngram_stats"], **k)),
        View("hashtag_gini", "hashtags", lambda out, **k: out["hashtags"]["hashtag_analysis"].select("timewindow_start", "gini", "gini_smooth")),
        View("hashtag_share", "hashtags", lambda out, **k: hashtags.share_with_users(_uses(out["hashtags"]["hashtag_analysis"]), **k)),
        View("hashtag_posts", "hashtags", lambda out, posts, **k: hashtags.raw_posts(posts, text="message_text", **k)),
        View("hashtag_users", "hashtags", lambda out, **k: hashtags.tag_users(_uses(out["hashtags"]["hashtag_analysis"]), **k)),
    ],
)


def _uses(analysis: DataFrame) -> DataFrame:
    """The fact table back from the aligned lists."""
    pairs = analysis.select(F.col("timewindow_start").cast("timestamp_ntz").alias("timewindow_start"), F.explode(F.arrays_zip("users", "hashtags")).alias("p"))
    return pairs.select("timewindow_start", F.col("p.users").alias("user_id"), F.col("p.hashtags").alias("hashtag"))
