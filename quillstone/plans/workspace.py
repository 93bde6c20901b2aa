"""The whole workflow over one store: mail to judgments, pages to documents, screenings, digests, reviews, versions.

Each method reads current views, applies operators and commits one batch, which becomes visible as a whole. Networks and
models are factories that the caller gives. Times are ISO texts that the caller gives too, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import html
from quillstone.functions.exprs import review_reason
from quillstone.functions.text import NARRATIVE, canonical_thresholds, threshold_conflicts
from quillstone.operators import audit, digest, evaluation, feedback, governance, ideas, models, narratives, replies, reports, sources, state, training
from quillstone.operators.joins import left_join_known
from quillstone.operators.log import EventLog, Migration, Store, consume_authorisation
from quillstone.operators.storage import literal_rows, materialize
from quillstone.sources import mail

_IDEA = ", ".join(f"{c} string" for c in models.EXTRACTED_IDEA)
_PREDICTED = "overall_prediction string, mispricing string, variant_perception string, upside string, business_quality string, downside string"
_TOLD = ", ".join(f"{c} array<string>" for c in NARRATIVE)
TABLES = {
    "messages": "message_id string, thread_id string, received_at string, sender string, subject string, body_raw string, body_format string, sender_authenticated string, feedback_parse_status string",
    "message_events": state.MESSAGE_EVENT,
    "fetch_failures": "message_id string, thread_id string, received_at string, sender string, recipients array<string>, subject string, sender_authenticated string, error string, failed_at string",
    "feedback": "feedback_id long, message_id string, event_index int, event_type string, verdict string, ticker string, company string, user_comment string, parsed_json string, confidence double, created_at string, "
                "excluded_from_learning boolean, feedback_origin string, holdout_eligible boolean, source_id long, screening_id long, assignment_id long",
    "feedback_events": state.FEEDBACK_EVENT,
    "sources": "source_id long, source_name string, external_id string, canonical_url string, source_title string, source_date string, discovered_at string, content_hash string, raw_capture_hash string, raw_text string, "
               "ticker string, company string, collection_status string, extraction_status string, previous_version long",
    "observations": "source_id long, source_name string, external_id string, observed_at string",
    "source_events": state.SOURCE_EVENT,
    "extractions": f"source_id long, {_IDEA}",
    "screenings": f"screening_id long, source_id long, created_at string, taste_version int, screen_rules_sha256 string, screening_prompt_version int, {_PREDICTED}, {_TOLD}, confidence string",
    "repairs": f"repair_id long, screening_id long, status string, missing_fields array<string>, {_TOLD}, reason string, attempted_at string",
    "ideas": "idea_id long, message_id string, source_status string, source_type string, source_text string, source_hash string, unscorable_reason string",
    "idea_extractions": f"idea_id long, {_IDEA}",
    "predictions": f"prediction_id long, idea_id long, created_at string, taste_version int, screen_rules_sha256 string, source_hash string, {_PREDICTED}, {_TOLD}, confidence string",
    "assignments": "assignment_id long, source_id long, assigned_at string",
    "shown": "source_id long, shown_at string",
    "deliveries": "delivery_id long, provider_thread_id string, sent_at string, taste_version int, idempotency_key string",
    "delivery_items": "delivery_id long, source_id long, position int",
    "versions": "version_number int, generated_at string, training_count long, checkpoint_feedback_id long, artifact string, artifact_sha256 string, rules_document string, permanent_rules_sha256 string",
    "version_training": "version_number int, feedback_id long",
    "rejected": "version_number int, rejected_at string, part string, content string, line int, excerpt string, reason string",
    "artifacts": "sha256 string, kind string, content string",
    "decisions": "version_number int, decision string, reason string, recorded_at string, evaluation_fingerprint string, consumed boolean",
}
SCHEMA_VERSION = 2


def _training_rows(log: EventLog) -> dict[str, DataFrame]:
    """The training ids of versions of schema 1, which had them in one array, as rows."""
    old = log.legacy("versions", "training_feedback_ids array<long>")
    return {"version_training": old.select("version_number", F.explode("training_feedback_ids").alias("feedback_id"))}


MIGRATIONS = (Migration(2, "training ids as rows", repair=_training_rows),)


class Unavailable(LookupError):
    """A frozen input that isn't there."""


class Tampered(RuntimeError):
    """A frozen input whose content isn't that of its hash."""


class Refused(PermissionError):
    """A draft that states a threshold which the permanent rules don't; conflicts has the findings."""

    def __init__(self, conflicts: list):
        super().__init__("; ".join(f"{c.part}, line {c.line}: {c.reason}" for c in conflicts))
        self.conflicts = conflicts


@dataclass(frozen=True)
class Evaluation:
    """Checks, which must all hold, and rows: judgments with prediction, kind, bucket, and the screening's ratings and narrative."""

    version: governance.Version
    checks: list[tuple[str, bool]]
    rows: DataFrame

    @property
    def passed(self) -> bool:
        return all(ok for _, ok in self.checks)


class Workspace:
    """A store of TABLES and what can be done with it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root, TABLES, guarded="messages", version=SCHEMA_VERSION, migrations=MIGRATIONS)
        self.log = self.store.log

    # Views

    def _table(self, name: str) -> DataFrame:
        return self.log.table(name)

    def messages(self) -> DataFrame:
        return state.current_messages(self._table("messages").drop("__seq"), self._table("message_events"), "__seq")

    def feedback(self) -> DataFrame:
        return state.current_feedback(self._table("feedback").drop("__seq"), self._table("feedback_events"), "__seq")

    def sources(self) -> DataFrame:
        """Versions with their state; ticker and company of the extraction where it found them."""
        found = self._table("extractions").drop("__seq").withColumnRenamed("ticker", "__ticker").withColumnRenamed("company", "__company")
        rows = state.current_source_state(self._table("sources").drop("__seq"), self._table("source_events"), "__seq").join(found,
            "source_id", "left")
        first = {c: F.coalesce(F.when(F.length(f"__{c}") > 0, F.col(f"__{c}")), c) for c in ("ticker", "company")}
        return rows.withColumns(first).drop("__ticker", "__company")

    def observations(self) -> DataFrame:
        return self._table("observations").withColumnRenamed("__seq", "observed_seq")

    def screenings(self) -> DataFrame:
        return narratives.effective(self._table("screenings").drop("__seq"), self._table("repairs").drop("__seq"))

    def ideas(self) -> DataFrame:
        """The latest record of each message's idea, with its extraction if there is one."""
        done = self._table("idea_extractions").drop("__seq")
        state_of = F.when(F.col("business_summary").isNotNull(), "EXTRACTED").otherwise("PENDING")
        return self.log.current("ideas", ["message_id"]).drop("__seq").join(done, "idea_id", "left").withColumn("extraction_status",
            state_of)

    def assignments(self) -> DataFrame:
        """Assignments with judged_at, the first time a counted or excluded judgment named them."""
        judged = self._table("feedback").filter("assignment_id IS NOT NULL").groupBy("assignment_id").agg(F.min("created_at").alias("judged_at"))
        return self._table("assignments").drop("__seq").join(judged, "assignment_id", "left")

    def latest_version(self):
        """The newest version's row on the driver, or None."""
        return self._table("versions").orderBy(F.desc("version_number")).first()

    def _new(self, name: str, rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
        """Rows with new ids, in the form of a table; columns that they lack are null."""
        made = self.log.with_ids(name, rows, id_column, order)
        return self._formed(name, made)

    def _formed(self, name: str, rows: DataFrame) -> DataFrame:
        fields = [c.split(" ", 1) for c in TABLES[name].split(", ")]
        return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])

    # Mail and judgments

    def check_mail(self, messages: DataFrame) -> int:
        """Stores messages that aren't known; returns how many."""
        return self.log.append_new("messages", self._formed("messages", messages.withColumn("feedback_parse_status", F.lit("UNPARSED"))),
            ["message_id"]).count()

    def intake(self, client: str, checkpoint: str, at: str) -> dict[str, int]:
        """Stores all mail that a client lists and the store hasn't: a stream that goes on where its checkpoint ended, and one batch of the
        store for each of its batches, however often that is run. Bodies are fetched by tasks, for new ids alone. What can't be fetched is
        recorded and tried again by the next intake. Returns counts of stored and failed messages."""
        self.spark.dataSource.register(mail.MailListing)
        known = self.spark.read.format("mail_listing").option("client", client).option("unauthenticated", "false").load()
        counts = {"stored": 0, "failed": 0}

        def store(batch: DataFrame, number: int) -> None:
            listed = materialize(mail.with_authentication(batch, known))
            for k, n in self._take_in(listed, client, f"{checkpoint}#{number}", at).items():
                counts[k] += n

        waiting = self._waiting()
        if waiting.limit(1).count():
            for k, n in self._take_in(materialize(waiting), client, None, at).items():
                counts[k] += n
        stream = self.spark.readStream.format("mail_listing").option("client", client).load()
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return counts

    def _waiting(self) -> DataFrame:
        """Listed messages whose fetch failed, and that no later one stored."""
        failed = self.log.current("fetch_failures", ["message_id"]).drop("__seq", "error", "failed_at")
        return failed.join(self._table("messages").select("message_id"), "message_id", "left_anti")

    def _take_in(self, listed: DataFrame, client: str, once: str | None, at: str) -> dict[str, int]:
        fresh = lambda rows: rows.join(self._table("messages").select("message_id"), "message_id", "left_anti")
        got = materialize(mail.fetched(fresh(listed.dropDuplicates(["message_id"])), client))  # each is fetched once
        bad = got.filter("error IS NOT NULL").withColumn("failed_at", F.lit(at))

        def work(seen: int) -> dict[str, int]:
            if once is not None and any(m.get("once") == once for m in self.log.batches()):
                return {"stored": 0, "failed": 0}
            good = fresh(mail.as_messages(got.filter("error IS NULL").drop("error")))
            n = {"stored": good.count(), "failed": bad.count()}
            if any(n.values()) or once is not None:
                self.log.commit(expect=seen, note={"once": once} if once else None, messages=self._formed("messages", good),
                    fetch_failures=self._formed("fetch_failures", bad))
            return n

        return self.log.again(work)

    def parse_mail(self, allowed: list[str], at: str, reader: Callable | None = None) -> DataFrame:
        """Reads every pending message by the parser that its route names, and commits events, states and attempts together.

        Returns message_id, route and status. Without a reader, messages that need a model stay pending.
        """
        seen = self.log.seen()
        pending = feedback.pending_messages(self.messages())
        routed = materialize(feedback.route_messages(pending, self.feedback(), self._table("deliveries"), allowed).join(
            digest.delivery_by_thread(self._table("deliveries")).select(F.col("provider_thread_id").alias("thread_id"), "delivery_id"),
            "thread_id", "left"))
        of = lambda *r: routed.filter(F.col("route").isin(*r))
        bodies = lambda r: of(r).select("message_id", F.col("body_raw").alias("body"), "delivery_id")
        items = digest.delivery_items(self._table("delivery_items"), self.sources()).select("delivery_id", "source_id", "ticker", "company")
        answers = materialize(replies.digest_replies(bodies("DIGEST_REPLY"), items))
        blind = materialize(replies.blind_reviews(bodies("BLIND_REVIEW"), self.assignments(), self.feedback()))
        seen_screens = materialize(replies.screen_reviews(bodies("SCREEN_REVIEW"), self._table("screenings"), self.feedback()))
        told = [replies.as_feedback(answers, "DIGEST_REPLY", True), replies.as_feedback(blind, "BLIND_REVIEW", True),
            replies.as_feedback(seen_screens, "SCREEN_REVIEW", False)]
        refs = lambda r: r.filter("ok").select("message_id", F.posexplode("blocks").alias("event_index", "b")).select("message_id",
            "event_index", F.col("b.ref").alias("ref"))
        told[1] = told[1].join(refs(blind).withColumnRenamed("ref", "assignment_id"), ["message_id", "event_index"])
        told[2] = told[2].join(refs(seen_screens).withColumnRenamed("ref", "screening_id"), ["message_id", "event_index"])
        named = self.sources().select("source_id", "ticker", "company")
        rows = told[0].unionByName(told[1], allowMissingColumns=True).unionByName(told[2], allowMissingColumns=True).join(named,
            "source_id", "left")
        outcome = lambda r: r.select("message_id", F.when(F.col("ok"), "PARSED").otherwise("NEEDS_REVIEW").alias("status"),
            F.col("reason").alias("error"))
        outcomes = outcome(answers).unionByName(outcome(blind)).unionByName(outcome(seen_screens))
        skipped = of("SKIPPED_SENDER", "SKIPPED_UNAUTHENTICATED", "NEEDS_REVIEW").select("message_id", F.col("route").alias("status"),
            F.when(F.col("route") == "NEEDS_REVIEW", "UNMATCHED_DIGEST_REPLY").alias("error"))
        # Messages that have events already, from a run that ended early: their state follows from these.
        doubt = self.feedback().withColumn("__why", review_reason(F.col("event_type"), F.col("verdict"),
            F.col("confidence"))).groupBy("message_id").agg(F.bool_or(F.col("__why").isNotNull()).alias("doubt"))
        resynced = of("RESYNC").join(doubt, "message_id").select("message_id",
            F.when(F.col("doubt"), "NEEDS_REVIEW").otherwise("PARSED").alias("status"), F.lit(None).cast("string").alias("error"))
        outcomes = outcomes.unionByName(skipped).unionByName(resynced)
        tried = of("DIGEST_REPLY", "BLIND_REVIEW", "SCREEN_REVIEW")
        if reader is not None:
            events, read = models.feedback_events(of("MODEL").select("message_id", "body_raw"), "body_raw", reader)
            rows = rows.unionByName(events.withColumns({"feedback_origin": F.lit("DIRECT"), "holdout_eligible": F.lit(True),
                "excluded_from_learning": F.lit(False)}), allowMissingColumns=True)
            outcomes = outcomes.unionByName(read.withColumn("error", F.when(F.col("status").isin("ERROR", "RETRYABLE_ERROR"),
                F.col("status"))))
            tried = of("DIGEST_REPLY", "BLIND_REVIEW", "SCREEN_REVIEW", "MODEL")
        outcomes, rows = materialize(outcomes), materialize(rows.withColumn("created_at", F.lit(at)))
        changed = state.status_changes(outcomes, F.col("status"), at, F.col("error"))
        self.log.commit(expect=seen, feedback=self._new("feedback", rows, "feedback_id", ["message_id", "event_index"]),
            message_events=changed.unionByName(state.attempts(tried, at)))
        return outcomes.join(routed.select("message_id", "route"), "message_id").select("message_id", "route", "status")

    def exclude(self, at: str, about: str | None = None, ids: list[int] | None = None, excluded: bool = True) -> int:
        """Takes judgments about an idea, or of given ids, out of learning or back in; returns how many changed."""
        def work(seen: int) -> int:
            rows = materialize(state.exclusions(self.feedback(), at, about, ids, excluded))
            if n := rows.count():
                self.log.commit(expect=seen, feedback_events=rows)
            return n

        return self.log.again(work)

    def requeue(self, at: str, message_ids: list[str] | None = None) -> int:
        """Puts messages in error or review, all or the given ones, back in the queue; returns how many."""
        def work(seen: int) -> int:
            m = self.messages() if message_ids is None else self.messages().filter(F.col("message_id").isin(message_ids))
            changed, gone = (materialize(x) for x in state.requeued(m, self.feedback(), at))
            if n := changed.count():
                self.log.commit(expect=seen, message_events=changed, feedback_events=gone)
            return n

        return self.log.again(work)

    def approve(self, message_id: str, at: str) -> bool:
        def work(seen: int) -> bool:
            rows = materialize(state.approved(self.messages().filter(F.col("message_id") == message_id), self.feedback(), at))
            if found := rows.count() > 0:
                self.log.commit(expect=seen, message_events=rows)
            return found

        return self.log.again(work)

    def status(self) -> DataFrame:
        """One row: messages by state, judgments, and rows that break an invariant."""
        m, f = self.messages(), self.feedback()
        n = f.agg(F.count("*").alias("n_feedback"))
        bad = feedback.invariant_violations(f, m).agg(F.count("*").alias("n_violations"))
        return feedback.status_counts(m).join(n).join(bad)  # one row each

    # Documents

    def collect(self, pages: DataFrame, source_name: str, at: str) -> DataFrame:
        """Stores fetched pages (external_id, canonical_url, html, and what the discovery found) as versions of their documents; returns external_id and action."""
        seen = self.log.seen()
        docs = materialize(html.pitch_documents(pages).withColumn("source_name", F.lit(source_name)))
        whole = F.col("content_complete") & F.col("invalid_reason").isNull()
        fetched = docs.withColumn("content_complete", whole)
        what = materialize(sources.resolve_fetched(fetched, self.sources().select("source_id", *sources.DOCUMENT, "content_hash",
            "collection_status"), self.observations()))
        status = F.when(F.col("content_complete"), "COLLECTED").otherwise("INCOMPLETE_CONTENT")
        own = what.filter("action = 'insert'").withColumns({"source_title": F.col("title"), "source_date": F.col("published_at"),
            "discovered_at": F.lit(at), "collection_status": status, "extraction_status": F.lit("PENDING")})
        made = materialize(self._new("sources", own, "source_id", sources.DOCUMENT))
        seen_now = made.select("source_id",
            *sources.DOCUMENT).unionByName(what.filter("action <> 'insert'").select(F.col("known_id").alias("source_id"),
            *sources.DOCUMENT)).withColumn("observed_at", F.lit(at))
        raised = what.filter("action = 'promote'").select(F.col("known_id").alias("source_id"), F.lit("STATUS").alias("kind"),
            F.lit("COLLECTED").alias("collection_status"), F.lit(None).cast("string").alias("reason"), F.lit(at).alias("at"))
        invalid = made.join(what.select(*sources.DOCUMENT, "invalid_reason").filter("invalid_reason IS NOT NULL"),
            sources.DOCUMENT).select("source_id", F.lit("INVALID").alias("kind"), "collection_status",
            F.col("invalid_reason").alias("reason"), F.lit(at).alias("at"))
        self.log.commit(expect=seen, sources=made, observations=self._formed("observations", seen_now),
            source_events=raised.unionByName(invalid))
        return what.select("external_id", "action")

    def repair_content(self, pages: DataFrame, at: str) -> int:
        """Marks complete versions whose stored page (source_id, html) holds no content; returns how many. Nothing is deleted."""
        self.log.snapshot(f"before-content-repair-{at.replace(':', '')}")

        def work(seen: int) -> int:
            rows = materialize(state.content_repairs(self.sources(), pages, at))
            if n := rows.count():
                self.log.commit(expect=seen, source_events=rows)
            return n

        return self.log.again(work)

    def extract(self, source_name: str, factory: Callable, at: str) -> DataFrame:
        """Has a model read the versions that wait for it; returns source_id and status. Failures wait on."""
        seen = self.log.seen()
        todo = sources.pending_extraction(self.sources(), self.observations(), source_name).select("source_id", "raw_text")
        read = materialize(models.apply_model(todo, "raw_text", factory, models.EXTRACTED_IDEA))
        good = read.filter("status = 'OK'").select("source_id", models.checked_json(F.col("answer"),
            models.EXTRACTED_IDEA).alias("i")).select("source_id", "i.*")
        done = good.select("source_id", F.lit("EXTRACTED").alias("kind"),
            *[F.lit(None).cast("string").alias(c) for c in ("collection_status", "reason")], F.lit(at).alias("at"))
        self.log.commit(expect=seen, extractions=self._formed("extractions", good), source_events=done)
        return read.select("source_id", "status")

    def screen(self, taste_version: int, rules_sha256: str, prompt: Column, factory: Callable, at: str, prompt_version: int = 1,
            external_id: str | None = None) -> DataFrame:
        """Screens ready versions that have no screening of this version and rules, all or one document's; returns source_id and status.
        The version's document and the rules must be there, unchanged: frozen()."""
        self.frozen(taste_version, rules_sha256)
        seen = self.log.seen()
        todo = sources.missing_screening(self.sources(), self.observations(), self._table("screenings"), taste_version, rules_sha256)
        todo = todo if external_id is None else todo.filter(F.col("external_id") == external_id)
        read = materialize(models.apply_model(todo.select("source_id", prompt.alias("__prompt")), "__prompt", factory, models.PREDICTION))
        good = read.filter("status = 'OK'").select("source_id", models.checked_json(F.col("answer"),
            models.PREDICTION).alias("p")).select("source_id", "p.*").withColumns(
            {"created_at": F.lit(at), "taste_version": F.lit(taste_version), "screen_rules_sha256": F.lit(rules_sha256),
            "screening_prompt_version": F.lit(prompt_version)})
        self.log.commit(expect=seen, screenings=self._new("screenings", good, "screening_id", ["source_id"]))
        return read.select("source_id", "status")

    def repair_narratives(self, factory: Callable, at: str) -> DataFrame:
        """One repair for each screening that lacks narrative and had none: the model gets the gaps' names; returns screening_id and status."""
        seen = self.log.seen()
        todo = narratives.repairable(self._table("screenings").drop("__seq"), self._table("repairs"))
        rows = todo.withColumn("__prompt", F.concat_ws(" ", F.concat(F.lit("SCREENING "), F.col("screening_id").cast("string"),
            F.lit(" LACKS")), F.array_join("gaps", " "), F.lit(f"GIVE EACH AT MOST {models.REPAIR_ITEMS} ITEMS OF AT MOST {models.REPAIR_CHARS} CHARACTERS, AND NOTHING ELSE")))
        read = materialize(models.apply_model(rows, "__prompt", factory, lambda r: models.repair_fields(list(r["gaps"])), attempts=1))
        answered = read.withColumns({"answer": models.checked_json(F.col("answer"), models.repair_fields(list(NARRATIVE))),
            "code": F.col("status")})
        made = materialize(narratives.judged_repairs(answered).withColumn("attempted_at", F.lit(at)))
        self.log.commit(expect=seen, repairs=self._new("repairs", made, "repair_id", ["screening_id"]))
        return made.select("screening_id", "status")

    def repairs(self) -> DataFrame:
        """Every repair of the newest screenings, with what came back and whether the narrative is whole now."""
        return narratives.repair_listing(self._table("screenings").drop("__seq"), self._table("repairs").drop("__seq"))

    # Digests and blind reviews

    def digest(self, taste_version: int) -> DataFrame:
        """The ideas that the next digest would show, with position."""
        told = self.screenings()
        pool = digest.digest_pool(self.sources(), self.observations(), self._table("screenings"), self._table("shown"), taste_version)
        gaps = narratives.with_gaps(told).select("screening_id", "gap", *NARRATIVE, "confidence", *reports.DIMENSIONS)
        chosen = digest.select_digest(digest.judged_pool(pool.join(gaps, "screening_id"), self.feedback(), self.messages()))
        return chosen.join(self.sources().select("source_id", "source_name", "canonical_url"), "source_id")

    def send_digest(self, taste_version: int, at: str, send: Callable[[str, str, str], str]) -> str | None:
        """Sends the digest by send(subject, body, idempotency key) -> thread id, then records it; None if there is nothing to send.

        A failed send raises and records nothing; a repeated one has the same key.
        """
        from quillstone.functions.exprs import idempotency_key

        seen, day = self.log.seen(), at[:10]
        chosen = materialize(self.digest(taste_version))  # at most DIGEST_SIZE rows
        if not chosen.limit(1).count():
            return None
        key = chosen.agg(F.collect_list("source_id").alias("ids")).select(idempotency_key(F.lit(day), F.col("ids")).alias("k")).first().k
        thread = send(reports.digest_subject(day), reports.digest_body(chosen, digest.DIGEST_SIZE), key)
        one = self.spark.range(1).select(F.lit(thread).alias("provider_thread_id"), F.lit(at).alias("sent_at"),
            F.lit(taste_version).alias("taste_version"), F.lit(key).alias("idempotency_key"))
        delivery = materialize(self._new("deliveries", one, "delivery_id", ["sent_at"]))
        items = self._formed("delivery_items", chosen.select("source_id",
            "position").crossJoin(F.broadcast(delivery.select("delivery_id"))))  # one delivery
        self.log.commit(expect=seen, deliveries=delivery, delivery_items=items,
            shown=self._formed("shown", chosen.select("source_id").withColumn("shown_at", F.lit(at))))
        return thread

    def assign_reviews(self, limit: int, at: str) -> DataFrame:
        """Assigns up to limit sources for blind review; returns assignment_id and source_id."""
        seen, src = self.log.seen(), self.sources().withColumn("discovered_seq", F.col("discovered_at"))
        pool = digest.blind_review_pool(src, self.observations(), self._table("shown"), self._table("assignments"),
            self._table("screenings"), self.feedback())
        known = digest.judged_or_assigned(self.feedback(), self.messages(), self._table("assignments").join(src, "source_id"))
        chosen = materialize(digest.greedy_assignments(pool, known, limit).withColumn("assigned_at", F.lit(at)))
        made = materialize(self._new("assignments", chosen, "assignment_id", ["position"]))
        self.log.commit(expect=seen, assignments=made)
        return made.select("assignment_id", "source_id")

    # Blind predictions of mailed ideas

    def shadow_score(self, taste_version: int, checkpoint: int, rules_sha256: str, at: str, extractor: Callable,
            predictor: Callable) -> DataFrame:
        """Isolates, extracts and predicts the ideas of hold-out messages, each step once; returns the counters. Inputs are frozen()."""
        self.frozen(taste_version, rules_sha256)
        seen = self.log.seen()
        pool = feedback.holdout_pool(self.feedback(), self.messages(), checkpoint)
        before = self.ideas()
        fresh = materialize(ideas.isolated(self.messages(), pool, before.select("message_id",
            "source_status")).join(before.select("message_id", F.col("idea_id").alias("__known")), "message_id", "left"))
        new = self._new("ideas", fresh.filter("__known IS NULL"), "idea_id", ["message_id"])
        again = self._formed("ideas", fresh.filter("__known IS NOT NULL").withColumn("idea_id", F.col("__known")))
        seen = self.log.commit(expect=seen, ideas=new.unionByName(again))
        read = materialize(ideas.extraction(self.ideas().drop(*models.EXTRACTED_IDEA), extractor))
        seen = self.log.commit(expect=seen, idea_extractions=self._formed("idea_extractions", read.filter("status = 'OK'").select("idea_id",
            "idea.*")))
        made = materialize(ideas.screening(self.ideas(), self._table("predictions"), "core_thesis", predictor, taste_version,
            rules_sha256).withColumn("created_at", F.lit(at)))
        self.log.commit(expect=seen, predictions=self._new("predictions", ideas.new_predictions(made, self._table("predictions")),
            "prediction_id", ["idea_id"]))
        return ideas.sweep_counters(self.ideas(), self._table("predictions"), self.feedback(), self.messages(), checkpoint, taste_version)

    def shadow_results(self) -> DataFrame:
        return ideas.revealed(self.ideas(), self._table("predictions"), self.feedback(), self.messages())

    # Versions

    def freeze(self, kind: str, content: str) -> str:
        """Stores a text under the hash of its content and returns that; a text is stored once."""
        import hashlib

        sha = hashlib.sha256(content.encode()).hexdigest()
        self.log.append_new("artifacts", self.spark.createDataFrame([(sha, kind, content)], TABLES["artifacts"]), ["sha256"])
        return sha

    def _intact(self, content: str | None, sha: str, what: str) -> str:
        import hashlib

        if content is None:
            raise Unavailable(f"{what} isn't in the store")
        if hashlib.sha256(content.encode()).hexdigest() != sha:
            raise Tampered(f"{what} isn't what its hash says")
        return content

    def artifact(self, sha: str) -> str:
        """A frozen text, checked against its hash."""
        row = self._table("artifacts").filter(F.col("sha256") == sha).first()
        return self._intact(None if row is None else row.content, sha, f"the artifact {sha[:12]}")

    def frozen(self, taste_version: int, rules_sha256: str) -> tuple[str, str]:
        """The document of a version and the rules of a hash, both checked as they are read; Unavailable or Tampered otherwise."""
        row = self._table("versions").filter(F.col("version_number") == taste_version).first()
        document = self._intact(None if row is None else row.artifact, "" if row is None else row.artifact_sha256, f"version {taste_version}")
        return document, self.artifact(rules_sha256)

    def conflicts(self, parts: list[tuple[str, str]], permanent_rules: str) -> list:
        """part, line, excerpt and reason of each hard threshold in the parts (name, text) that the permanent rules don't have."""
        texts, rules = literal_rows(self.spark, parts, "part string, text string"), F.lit(permanent_rules)
        found = texts.select("part", F.explode(threshold_conflicts(F.col("text"), canonical_thresholds(rules, "%"),
            canonical_thresholds(rules, "x"))).alias("c"))
        return found.select("part", "c.*").orderBy("part", "line", "reason").collect()  # a document's lines

    def build_version(self, at: str, write: Callable[..., str], propose: Callable[..., str], permanent_rules: str,
            most_records: int = 100_000, tried: Callable[[int, str], None] | None = None) -> int:
        """Builds the next version from all eligible judgments: write(prompt, budget) gives the document's text, propose(prompt, budget)
        candidate rules as JSON. Both are asked again a few times if an answer is of no use: models.drafted().

        The first version needs enough judgments; each later one a full hold-out and a recorded RETRAIN that no build has
        used. The permanent rules come first in the prompt, and a draft that states a threshold of its own is kept as
        rejected and Refused. The version, its training ids and the use of its authorisation are one batch.
        """
        import hashlib

        if not permanent_rules.strip():
            raise PermissionError("NO_PERMANENT_RULES")
        seen, latest = self.log.seen(), self.latest_version()
        rows = feedback.eligible_feedback(self.feedback(), self.messages())
        n = rows.agg(F.count("*").alias("n"), F.max("feedback_id").alias("last")).first()
        held = 0 if latest is None else feedback.holdout_pool(self.feedback(), self.messages(), latest.checkpoint_feedback_id).count()
        unlocked = latest is not None and self.decision(latest.version_number) == ("RETRAIN", False)
        version = None if latest is None else governance.Version(latest.version_number, latest.checkpoint_feedback_id,
            latest.artifact_sha256, unlocked)
        if why := governance.may_build(n.n, held, version, unlocked):
            raise PermissionError(why)
        number = 1 if latest is None else latest.version_number + 1
        prompt = f"PERMANENT RULES, WHICH STAND ABOVE ALL ELSE\n\n{permanent_rules.strip()}\n\n{n.n} JUDGMENTS\n\n" + training.corpus(
            training.training_records(rows), most_records)
        body = models.drafted(write, prompt, tried=tried)
        proposed = models.drafted(propose, prompt, models.CANDIDATE_RULES, tried=tried)["rules"]
        rules = self.spark.createDataFrame([tuple(r[c] for c in models.CANDIDATE_RULE) for r in proposed],
            ", ".join(f"{c} string" for c in models.CANDIDATE_RULE))
        kept = training.valid_rules(rules).collect()  # at most MOST_RULES
        parts = [("document", body), *((f"rule {i}", "\n".join((r.rule, r.evidence, r.reusability))) for i, r in enumerate(kept, 1))]
        if bad := self.conflicts(parts, permanent_rules):
            texts = dict(parts)
            self.log.commit(expect=seen, rejected=self.spark.createDataFrame([(number, at, c.part, texts[c.part], c.line, c.excerpt,
                c.reason) for c in bad], TABLES["rejected"]))
            raise Refused(bad)
        document = training.preference_document(f"v{number}", at[:10], n.n, body)
        rules_sha = hashlib.sha256(permanent_rules.encode()).hexdigest()
        row = [(number, at, n.n, n.last, document, hashlib.sha256(document.encode()).hexdigest(),
            training.rules_document(f"v{number}", at[:10], rules), rules_sha)]
        frames = {"versions": self.spark.createDataFrame(row, TABLES["versions"]),
            "version_training": rows.select(F.lit(number).alias("version_number"), "feedback_id")}
        if latest is None:
            self.log.commit(expect=seen, **frames)
        else:
            consume_authorisation(self.log, "decisions", latest.version_number, seen, **frames)
        return number

    def decision(self, version: int) -> tuple[str, bool] | None:
        """The decision on a version and whether a build has used it."""
        row = self.log.current("decisions", ["version_number"]).filter(F.col("version_number") == version).first()
        return None if row is None else (row.decision, row.consumed)

    def record_decision(self, record: dict) -> None:
        """Records a decision of governance.decision_record() for its version; a version takes one."""
        seen = self.log.seen()
        if self._table("decisions").filter(F.col("version_number") == record["taste_version"]).limit(1).count():
            raise PermissionError(f"version {record['taste_version']} has a decision")
        row = [(record["taste_version"], record["decision"], record["reason"], record["recorded_at"],
            record["evaluation_fingerprint"], False)]
        self.log.commit(expect=seen, decisions=self.spark.createDataFrame(row, TABLES["decisions"]))

    def _audited(self, checkpoint: int) -> tuple[DataFrame, DataFrame]:
        """Rows after a checkpoint with role and problems, and the duplicate groups of official and candidate ones. Both are written."""
        f = self.feedback()
        newest = sources.latest_screening(self._table("screenings")).select("source_id", F.col("screening_id").alias("__newest"),
            F.col("created_at").alias("screened_at"))
        of = self.sources().select("source_id", "source_name", "external_id")
        rows = audit.roles(f, self.messages(), checkpoint, state.repaired_duplicates(self._table("feedback_events"))).join(of, "source_id",
            "left").join(newest, "source_id", "left")
        rows = rows.withColumnRenamed("screening_id", "explicit_screening_id").withColumnRenamed("__newest",
            "screening_id").withColumnRenamed("created_at", "judged_at")
        rows = materialize(rows)
        n = audit.usable_judgments(f, self.messages(), self._table("assignments"))
        shown = self._table("shown").groupBy("source_id").agg(F.min("shown_at").alias("shown_at"))
        exposed = audit.exposure_counts(f, f.filter(F.col("feedback_origin").isin("SCREEN_REVIEW", "DIGEST_REPLY")), "created_at")
        judged = left_join_known(left_join_known(rows, n, "assignment_id"), shown, "source_id").join(exposed, "feedback_id", "left")
        before = f.filter(F.col("feedback_id") <= checkpoint).join(of, "source_id", "left")
        judged = audit.validity_problems(judged.join(audit.training_overlap(rows, before).select("feedback_id",
            F.col("level").alias("training_level")), "feedback_id", "left"))
        return materialize(judged), audit.duplicate_groups(rows.filter(F.col("role").isin("official", "candidate")))

    def audit(self, checkpoint: int) -> DataFrame:
        """One row of audit.audit_summary() over the store."""
        return audit.audit_summary(*self._audited(checkpoint))

    def remediation(self, checkpoint: int) -> list[str]:
        """What a person should do about the hold-out; nothing is changed."""
        rows, groups = self._audited(checkpoint)
        held = rows.filter(F.col("role").isin("official", "candidate"))
        plan = audit.remediation(held, groups, audit.group_report(groups, audit.identity_keys(held)))
        return audit.remediation_plan(audit.audit_summary(rows, groups).first(), plan, held)

    def evaluation(self, version: int) -> Evaluation:
        """Holds the official hold-out of the newest version against the predictions that existed before each judgment. Reads only."""
        latest = self.latest_version()
        if latest is None:
            raise Unavailable("there is no version")
        rows, groups = self._audited(latest.checkpoint_feedback_id)
        official = rows.filter("role = 'official'").select("feedback_id", "source_id", "judged_at", "verdict", "user_comment", "ticker", "company")
        told = self._table("screenings")
        held = evaluation.asof_predictions(official, told, latest.version_number)
        mixed = evaluation.prompt_versions(official, told, latest.version_number)
        members = materialize(held.join(mixed, "feedback_id", "left"))
        decided = self.decision(latest.version_number)
        found = governance.Version(latest.version_number, latest.checkpoint_feedback_id, latest.artifact_sha256, decided == ("RETRAIN", False))
        twice = groups.groupBy("component").count().filter("count > 1").count()
        checks = governance.gate_checks(found, version, latest.artifact.encode(), audit.audit_summary(rows, groups), twice, members, decided is not None)
        facts = self.screenings().select("screening_id", *reports.DIMENSIONS, "confidence", *NARRATIVE)
        return Evaluation(found, checks, evaluation.evaluation_rows(members).join(facts, "screening_id", "left"))

    def evaluation_report(self, version: int, rules_text: str) -> str:
        """The checks, and where all hold the metrics, the errors with their reasons and what their texts have in common."""
        e = self.evaluation(version)
        out = reports.evaluation_report(evaluation.metrics(e.rows), evaluation.confusion_matrix(e.rows), e.checks)
        if not e.passed:
            return out
        warnings = [r.warning for r in evaluation.balance_warnings(evaluation.metrics(e.rows)).collect()]
        wrong = evaluation.theme_report(evaluation.text_items(e.rows.filter("kind = 'false_negative'"), "feedback_id"), "feedback_id")
        hits = evaluation.hurdle_hits(evaluation.text_items(e.rows, "feedback_id"), "feedback_id")
        return "\n".join([out, *(f"warning: {w}" for w in warnings), reports.error_report(e.rows, hits, wrong, rules_text)])

    def decide(self, version: int, decision: str, reason: str, rules_sha256: str, at: str, dry_run: bool = False) -> dict:
        """Records what an evaluation led to, after a snapshot: RETRAIN lets one build, ACCEPT none. Refused unless the evaluation's checks
        all hold and the rules are intact; a version takes one decision. Returns the record."""
        if not reason.strip():
            raise ValueError("a decision needs a reason")
        self.artifact(rules_sha256)
        if self.decision(version) is not None:
            raise PermissionError(f"version {version} has a decision")
        e = self.evaluation(version)
        if not e.passed:
            raise PermissionError("; ".join(name for name, ok in e.checks if not ok))
        record = governance.decision_record(e.version, e.rows, evaluation.metrics(e.rows), rules_sha256, decision, reason.strip(), at)
        if not dry_run:
            self.log.snapshot(f"before-decision-{version}")
            self.record_decision(record)
        return record

    def version_status(self) -> dict:
        """The newest version: its judgments, hold-out, decision, what may be built, labels, and whether its document is intact."""
        v = self.latest_version()
        if v is None:
            return {"version": None, "least_training_records": governance.LEAST_TRAINING_RECORDS}
        f, m, decided = self.feedback(), self.messages(), self.decision(v.version_number)
        able = feedback.eligible_feedback(f, m)
        held = feedback.holdout_pool(f, m, v.checkpoint_feedback_id).count()
        trained = f.join(self._table("version_training").filter(F.col("version_number") == v.version_number).select("feedback_id"), "feedback_id", "left_semi")
        labels_of = lambda rows: feedback.label_distribution(rows).first().asDict()
        try:
            intact = bool(self._intact(v.artifact, v.artifact_sha256, "the document"))
        except Tampered:
            intact = False
        building = "LOCKED" if decided is None or decided[0] != "RETRAIN" else "USED" if decided[1] else "ONE_BUILD_AUTHORISED"
        return {"version": v.version_number, "training_judgments": v.training_count, "holdout": held, "holdout_complete": held >= audit.HOLDOUT_SIZE,
            "decision": decided and decided[0], "building": building, "awaiting_evaluation": held >= audit.HOLDOUT_SIZE and decided is None,
            "eligible": able.count(), "by_origin": {r[0]: r[1] for r in feedback.count_by_origin(f).collect()},
            "unjudged_assignments": self.assignments().filter("judged_at IS NULL").count(), "intact": intact,
            "labels_of_training": labels_of(trained), "labels_of_next": labels_of(able)}

    def exclude_duplicate(self, checkpoint: int, exclude: int, retain: int, expected: dict, reason: str, at: str,
            dry_run: bool = False) -> list[str]:
        """Takes a confirmed duplicate out of the hold-out, after a snapshot; returns what speaks against it, and then nothing changes."""
        seen = self.log.seen()
        rows = audit.roles(self.feedback(), self.messages(), checkpoint, state.repaired_duplicates(self._table("feedback_events")))
        failures, event = state.duplicate_repair(rows, exclude, retain, expected, reason, at)
        if event is not None and not dry_run:
            self.log.snapshot(f"before-duplicate-repair-{exclude}")
            self.log.commit(expect=seen, feedback_events=event)
        return failures
