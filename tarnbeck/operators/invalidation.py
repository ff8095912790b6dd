"""What new evidence makes stale: questions to reopen or revive, pages and report sections to write again.

Two causes are followed, in this order. Dependency: a reference was replaced by a later source, or the artifact that it
names now has a strictly newer stamp than the reference took. Subscription: evidence of a kind that a question's section
subscribes to arrived after the answer. An answered question is reopened by the first stale reference, else by the first
arrival; a deferred one is revived by any arrival; other questions stay. Pages go stale by dependency alone and take the
sections they back with them.

References of questions, pages and derived entries are judged alike, by one join with the stamps of what stands and one
with the replaced ids, each with one row an id; a consumer keeps its first stale reference by a partial aggregation. So
neither an artifact that everything refers to nor a page with very many references meets in one task. Questions look up
their arrival by section and answer time, for which it is found once. What is used more than once (artifacts, stamps,
replaced ids, and in the report causes and pages) is written once to the shared folder.

Cases: a reference without a stamp is stale by replacement alone; equal stamps, unknown ids and null ids are fresh. A
question without a section has no subscription; one without an answer time is met by any arrival. Repeated rows count
once. Empty tables give empty outputs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions.shared import written
from tarnbeck.operators.provenance import first_after, moment

QUESTION, PAGE, DERIVED = "question", "page", "derived"


class Invalidation:
    """The outputs of one look at the evidence. Frames that come in:

    sources (id, supersedes) as they are now; artifacts (id, kind, ord, stamp), kind null for what no kind fetched;
    questions (hash, section, status, answered_at, ord); subscriptions (section, kind); pages (page, section, ord);
    references (level, key, ord, id, stamp), level being question, page or derived.
    """

    def __init__(self, sources: DataFrame, artifacts: DataFrame, questions: DataFrame, subscriptions: DataFrame, pages: DataFrame, references: DataFrame):
        self.sources, self.artifacts, self.pages = sources, artifacts, pages
        self.questions, self.subscriptions, self.references = questions, subscriptions, references
        self._causes: DataFrame | None = None
        self._dirty: DataFrame | None = None

    @cached_property
    def known(self) -> DataFrame:
        """The artifacts, as a table."""
        return written(self.artifacts.select("id", "kind", "ord", "stamp"), "artifacts")

    @cached_property
    def replaced(self) -> DataFrame:
        """id of what a later source has replaced, as a table."""
        return written(self.sources.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct(), "replaced")

    @cached_property
    def standing(self) -> DataFrame:
        """id, now: the stamps of artifacts that nothing has replaced, as a table."""
        return written(self.known.where("stamp IS NOT NULL").groupBy("id").agg(F.max("stamp").alias("now")).join(self.replaced, "id", "left_anti"), "standing")

    def stale_references(self) -> DataFrame:
        """level, key, ord, id, newer (by its stamp, not by replacement) of every stale reference."""
        gone = self.replaced.select("id", F.lit(True).alias("gone"))
        judged = self.references.join(self.standing, "id", "left").join(gone, "id", "left")
        newer = F.coalesce(F.col("now") > F.col("stamp"), F.lit(False))
        return judged.where(F.col("gone").isNotNull() | newer).select("level", "key", "ord", "id", F.col("gone").isNull().alias("newer"))

    def newer_references(self) -> DataFrame:
        """level, key, ord, id of references that are stale by a newer stamp."""
        return self.references.join(self.standing, "id").where("now > stamp").select("level", "key", "ord", "id")

    def first_stale(self, level: str) -> DataFrame:
        """key, id, newer, ord: of each consumer of a level the reference that is found first.

        The key alone groups, so that rows are sorted by numbers where keys are numbers and joins by key need no shuffle.
        """
        first = self.stale_references().where(F.col("level") == level).groupBy("key").agg(F.min(F.struct("ord", "id", "newer")).alias("r"))
        return first.select("key", "r.id", "r.newer", "r.ord")

    def causes(self) -> DataFrame:
        """hash, section, status, at (ord), cause, evidence of every answered or deferred question that has a cause."""
        if self._causes is not None:
            return self._causes
        stale = self.first_stale(QUESTION).select(F.col("key").alias("hash"), F.col("id").alias("_stale"), "newer")
        since = moment(F.when(F.col("status") == "answered", F.col("answered_at")))
        asked = self.questions.where(F.col("status").isin("answered", "deferred")).select("hash", "section", "status", "ord", since.alias("at"))
        arrivals = self.known.where("kind IS NOT NULL AND stamp IS NOT NULL")
        came = first_after(asked.select("section", "at").distinct(), arrivals, self.subscriptions)
        every = asked.join(stale, "hash", "left").join(came, ["section", "at"], "left")
        # rows of one hash are one question
        every = every.withColumn("_came", F.min("best").over(Window.partitionBy("hash"))["id"]).withColumn("_depends", (F.col("status") == "answered") & F.col("_stale").isNotNull())
        cause = F.when(F.col("_depends"), "dependency").when(F.col("_came").isNotNull(), "subscription")
        evidence = F.when(F.col("_depends"), F.col("_stale")).otherwise(F.col("_came"))
        new = F.when(F.col("_depends"), F.col("newer")).otherwise(True)
        return every.select("hash", "section", "status", F.col("ord").alias("at"), cause.alias("cause"), evidence.alias("evidence"), new.alias("new")).where("cause IS NOT NULL")

    def reopened(self) -> DataFrame:
        """hash, section, cause, evidence."""
        return self.causes().where("status = 'answered'").select("hash", "section", "cause", "evidence")

    def revived(self) -> DataFrame:
        """hash of deferred questions that have something to go by now."""
        return self.causes().where("status = 'deferred'").select("hash")

    def dirty_pages(self) -> DataFrame:
        """page, section, at (ord), evidence."""
        if self._dirty is not None:
            return self._dirty
        stale = self.first_stale(PAGE).select(F.col("key").alias("page"), F.col("id").alias("evidence"), "newer")
        return self.pages.join(stale, "page").select("page", "section", F.col("ord").alias("at"), "evidence", "newer")

    def dirty_sections(self) -> DataFrame:
        """section, at (of the first page that makes it dirty)."""
        return self.dirty_pages().where("section IS NOT NULL").groupBy("section").agg(F.min("at").alias("at"))

    def new_evidence(self) -> DataFrame:
        """id, level (0 superseding source, 1 question, 2 page, 3 derived entry), at: where each new artifact is met first.

        Of a question and a page the reference that decided counts, of a derived entry every one.
        """
        met = self.sources.where("supersedes IS NOT NULL").select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("at"))
        asked = self.causes().where("new").select(F.col("evidence").alias("id"), F.lit(1), F.col("at").cast("long"))
        paged = self.dirty_pages().where("newer").select(F.col("evidence").alias("id"), F.lit(2), F.col("at").cast("long"))
        derived = self.newer_references().where(F.col("level") == DERIVED).select("id", F.lit(3), F.col("ord").cast("long"))
        return met.union(asked).union(paged).union(derived).groupBy("id").agg(F.min(F.struct("level", "at")).alias("m")).select("id", "m.level", "m.at")

    def report(self) -> DataFrame:
        """All outputs in one frame: output, key, section, cause, evidence."""
        self._causes, self._dirty = written(self.causes(), "causes"), written(self.dirty_pages(), "pages")
        none = F.lit(None).cast("string")
        key = lambda c: F.col(c).cast("string").alias("key")
        return (
            self.reopened().select(F.lit("reopened").alias("output"), key("hash"), "section", "cause", F.col("evidence").cast("string").alias("evidence"))
            .union(self.revived().select(F.lit("revived"), key("hash"), none, none, none))
            .union(self.dirty_pages().select(F.lit("dirty page"), key("page"), "section", F.lit("dependency"), F.col("evidence").cast("string")))
            .union(self.dirty_sections().select(F.lit("dirty section"), key("section"), F.col("section"), none, none))
            .union(self.new_evidence().select(F.lit("new evidence"), key("id"), none, none, none))
        )


def applied(questions: DataFrame, plan: Invalidation) -> DataFrame:
    """hash, status after the plan: answered ones that it reopens, deferred ones that it revives to open. A second time changes nothing."""
    now = plan.causes().select("hash", F.when(F.col("status") == "answered", "reopened").otherwise("open").alias("_new"))
    return questions.join(now, "hash", "left").select("hash", F.coalesce("_new", "status").alias("status"))
