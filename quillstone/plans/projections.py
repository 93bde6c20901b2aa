"""Deterministic projections of the star-schema tables onto the screening model; one SQL text for Spark and DuckDB.

In each text a table in braces is a base table. Integer arithmetic only, so both engines agree on every value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PROJECTIONS = {
    "p_messages": """SELECT o_orderkey AS id, concat('m', cast(o_orderkey AS varchar(20))) AS message_id, concat('t', cast(o_custkey AS varchar(20))) AS thread_id, o_orderdate AS received_at,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'UNAUTHENTICATED' ELSE 'AUTHENTICATED' END AS sender_authenticated,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'PARSED' WHEN '2-HIGH' THEN 'PARSED' WHEN '3-MEDIUM' THEN 'NEEDS_REVIEW' WHEN '4-NOT SPECIFIED' THEN 'NO_FEEDBACK' ELSE 'UNPARSED' END AS feedback_parse_status FROM {orders}""",
    "p_feedback": """SELECT l_orderkey * 8 + l_linenumber AS feedback_id, concat('m', cast(l_orderkey AS varchar(20))) AS message_id, l_linenumber AS event_index,
 min(l_partkey) AS source_id, CASE WHEN min(l_partkey) % 9 = 0 THEN NULL ELSE concat('tk', cast(min(l_partkey) % 50 AS varchar(20))) END AS ticker,
 concat('Supplier, ', cast(min(l_suppkey) AS varchar(20)), ' Inc.') AS company,
 CASE cast(min(l_quantity) AS int) % 6 WHEN 0 THEN 'STRONG_LIKE' WHEN 1 THEN 'LIKE' WHEN 2 THEN 'MAYBE' WHEN 3 THEN 'PASS' WHEN 4 THEN 'STRONG_PASS' ELSE NULL END AS verdict,
 CASE min(l_returnflag) WHEN 'A' THEN 'BLIND_REVIEW' WHEN 'N' THEN 'DIRECT' ELSE 'SCREEN_REVIEW' END AS feedback_origin,
 CASE WHEN min(l_returnflag) = 'R' THEN 0 ELSE 1 END AS holdout_eligible, CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN 1 ELSE 0 END AS excluded_from_learning
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "p_sources": """SELECT p_partkey AS source_id, 'catalog' AS source_name, cast(floor(p_partkey / 3) AS bigint) AS external_id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat(' $TK', cast(p_partkey % 50 AS varchar(20))) END AS ticker, p_name AS company,
 CASE WHEN p_size % 4 = 0 THEN 'INCOMPLETE_CONTENT' ELSE 'COLLECTED' END AS collection_status, CASE WHEN p_partkey % 5 = 0 THEN 'PENDING' ELSE 'EXTRACTED' END AS extraction_status, p_partkey % 97 AS discovered_seq FROM {part}""",
    "p_observations": """SELECT p_partkey AS source_id, 'catalog' AS source_name, cast(floor(p_partkey / 3) AS bigint) AS external_id, (p_partkey * 7) % 13 AS observed_seq FROM {part}""",
    "p_screenings": """SELECT event_id AS screening_id, user_id AS source_id, ts AS created_at, 1 + event_id % 3 AS taste_version, 1 + event_id % 2 AS screening_prompt_version,
 CASE event_type WHEN 'purchase' THEN 'INVESTIGATE_NOW' WHEN 'click' THEN 'WATCH' WHEN 'signup' THEN 'WATCH' WHEN 'view' THEN 'PASS' ELSE 'INSUFFICIENT_INFORMATION' END AS overall_prediction FROM {events} WHERE event_id % 4 <> 0""",
    "p_judgments": """SELECT event_id AS feedback_id, user_id AS source_id, ts AS judged_at, CASE event_type WHEN 'purchase' THEN 'STRONG_LIKE' WHEN 'signup' THEN 'LIKE' WHEN 'click' THEN 'MAYBE' WHEN 'view' THEN 'PASS' ELSE 'STRONG_PASS' END AS verdict FROM {events} WHERE event_id % 4 = 0""",
    "p_shown": """SELECT p_partkey AS source_id, p_partkey % 89 AS shown_seq FROM {part} WHERE p_partkey % 17 = 0""",
    "p_assignments": """SELECT p_partkey AS assignment_id, p_partkey AS source_id, p_partkey % 83 AS assigned_seq, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_partkey % 61 END AS judged_seq FROM {part} WHERE p_partkey % 7 = 0""",
    "p_deliveries": """SELECT o_orderkey AS delivery_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '' ELSE concat('t', cast(o_custkey AS varchar(20))) END AS provider_thread_id, o_orderdate AS sent_at, 1 + o_orderkey % 3 AS taste_version FROM {orders}""",
    "p_delivery_items": """SELECT l_orderkey AS delivery_id, l_linenumber AS position, min(l_partkey) AS source_id FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "p_narratives": """SELECT event_id AS screening_id, split(CASE event_id % 3 WHEN 0 THEN ' N/A.;' WHEN 1 THEN concat('r', cast(event_id AS varchar(20)), ';...')
 ELSE CASE event_id % 4 WHEN 1 THEN 'one;a 3x at best;  a  large-cap  name ' WHEN 2 THEN 'well covered;no clear reason why;effective hurdle of 3 x, cyclical' ELSE 'one;two;13x;three' END END, ';') AS key_reasons,
 split(CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('a three-bagger; c', cast(event_id AS varchar(20)), ' trades below book') ELSE concat(' c', cast(event_id AS varchar(20))) END, ';') AS key_concerns,
 split(CASE event_id % 7 WHEN 0 THEN 'tbd;--' WHEN 1 THEN 'is 100 % needed?;no edge' ELSE 'why' END, ';') AS critical_questions FROM {events} WHERE event_id % 4 <> 0""",
    "p_repairs": """SELECT event_id AS repair_id, event_id - event_id % 4 + 1 AS screening_id, CASE event_id % 3 WHEN 0 THEN 'REPAIRED' WHEN 1 THEN 'STILL_INCOMPLETE' ELSE 'FAILED' END AS status, concat('reason ', cast(event_id AS varchar(20))) AS key_reason,
 split(CASE event_id % 2 WHEN 0 THEN concat('fr', cast(event_id AS varchar(20))) ELSE '' END, ';') AS key_reasons, split(CASE event_id % 5 WHEN 0 THEN 'none' ELSE 'fc' END, ';') AS key_concerns, split('fq;n/a', ';') AS critical_questions FROM {events}""",
    "p_message_events": """SELECT event_id AS seq, concat('m', cast((event_id * 7) % (SELECT count(*) FROM {orders}) AS varchar(20))) AS message_id, CASE event_type WHEN 'view' THEN 'ATTEMPT' ELSE 'STATUS' END AS kind,
 CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'PARSED' WHEN 'purchase' THEN 'NEEDS_REVIEW' WHEN 'signup' THEN 'RETRYABLE_ERROR' ELSE 'ERROR' END AS status, CASE event_type WHEN 'error' THEN concat('E', cast(event_id AS varchar(20))) ELSE NULL END AS error, ts AS at FROM {events}""",
    "p_feedback_events": """SELECT event_id AS seq, ((event_id * 13) % (SELECT count(*) FROM {orders})) * 8 + 1 + event_id % 5 AS feedback_id, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'INCLUDE' ELSE 'EXCLUDE' END AS kind FROM {events}""",
    "p_source_events": """SELECT event_id AS seq, (event_id * 11) % (SELECT count(*) FROM {part}) AS source_id, CASE event_type WHEN 'view' THEN 'OBSERVED' WHEN 'click' THEN 'EXTRACTED' WHEN 'error' THEN 'INVALID' ELSE 'STATUS' END AS kind,
 CASE event_type WHEN 'error' THEN 'INCOMPLETE_CONTENT' WHEN 'view' THEN NULL WHEN 'click' THEN NULL ELSE 'COLLECTED' END AS collection_status, CASE event_type WHEN 'error' THEN concat('R', cast(event_id AS varchar(20))) ELSE NULL END AS reason, ts AS at FROM {events}""",
    "p_ideas": """SELECT o_orderkey AS idea_id, concat('m', cast(o_orderkey AS varchar(20))) AS message_id, CASE WHEN o_orderkey % 4 = 0 THEN 'UNSCORABLE_SOURCE' ELSE 'ISOLATED' END AS source_status,
 CASE WHEN o_orderkey % 3 = 0 THEN 'PENDING' ELSE 'EXTRACTED' END AS extraction_status, concat('TK', cast(o_custkey % 50 AS varchar(20))) AS ticker, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('Co ', cast(o_custkey AS varchar(20))) END AS company FROM {orders}""",
    "p_predictions": """SELECT event_id AS prediction_id, (event_id * 17) % (SELECT count(*) FROM {orders}) AS idea_id, 1 + event_id % 3 AS taste_version, CASE WHEN event_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS screen_rules_sha256,
 CASE event_type WHEN 'purchase' THEN 'INVESTIGATE_NOW' WHEN 'click' THEN 'WATCH' WHEN 'signup' THEN 'WATCH' WHEN 'view' THEN 'PASS' ELSE 'INSUFFICIENT_INFORMATION' END AS overall_prediction FROM {events}""",
    "p_feed": """SELECT p_partkey AS part, concat('<title>Feed &amp; more</title><nav><a href="/home">Home</a></nav><ul><li class="row"><h3>', p_name, '</h3><div>', p_type, ' Works (', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZABCD', cast(p_partkey % 26 + 1 AS int), 3), ')</div><p>By Ann Lee Added to YB Jan ',
 cast(p_size AS varchar(20)), '</p><a href="/sp/', cast(p_partkey AS varchar(20)), '/share?x=1">Share this pitch</a></li><li><p>Pitch date: 2026-01-02 Source: Value Club</p><b>$', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZABCD', cast(p_partkey % 26 + 1 AS int), 2), '</b><a href="/sp/', cast(1000000 + p_partkey AS varchar(20)), '">Read full article</a></li></ul>',
 CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '<button role="switch" aria-checked="true">s</button>' WHEN 2 THEN '<i role="switch" data-state="unchecked"></i>' ELSE '<i role="switch" aria-checked="true"></i><span>Show full summary:</span><i role="switch" id="full-summary-switch"></i>' END) AS html FROM {part}""",
    "p_notes": """SELECT event_id AS note_id, concat(CASE event_id % 8 WHEN 0 THEN 'We require at least 3x here' WHEN 1 THEN 'It does not require 3x' WHEN 2 THEN 'an effective hurdle of sorts' WHEN 3 THEN 'must reach 90% or more' WHEN 4 THEN 'a 4x floor' WHEN 5 THEN '100% of the floor, a 3-bagger' WHEN 6 THEN 'plain words' ELSE 'three bagger, effective hurdle' END,
 chr(10), 'and more') AS text FROM {events}""",
    "p_replies": """SELECT o_orderkey AS reply_id, concat(CASE o_orderkey % 7 WHEN 0 THEN 'LIKE' WHEN 1 THEN concat(' maybe.', chr(10), 'so so') WHEN 2 THEN concat('PASS', chr(10), 'On Monday, Joe wrote:') WHEN 3 THEN concat('LIKE', chr(10), '> old', chr(10), 'new') WHEN 4 THEN concat('LIKE', chr(10), '-- ', chr(10), 'Joe')
 WHEN 5 THEN '   ' ELSE concat('PASS', chr(10), 'no', chr(10), 'Sent from my iPhone.') END, CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE '' END) AS body FROM {orders}""",
    "p_judged_notes": """SELECT event_id AS feedback_id, 'FEEDBACK' AS event_type, CASE event_type WHEN 'purchase' THEN 'STRONG_LIKE' WHEN 'click' THEN 'LIKE' ELSE NULL END AS verdict, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('TK', cast(user_id AS varchar(20))) END AS ticker, concat('Co ', cast(user_id AS varchar(20))) AS company,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'said' END AS user_comment, CASE event_id % 3 WHEN 0 THEN concat(chr(123), '"positive_reasons": ["p', cast(event_id AS varchar(20)), '", "q"], "concerns": []', chr(125)) WHEN 1 THEN 'no json' ELSE NULL END AS parsed_json FROM {events}""",
    "p_prospects": """SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('$k', cast(o_custkey AS varchar(20))) END AS ticker,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('House, ', cast(cast(floor(o_totalprice / 1000) AS bigint) AS varchar(20)), ' Ltd.') END AS company,
 (o_orderkey * 31) % 101 AS discovered_seq, CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END AS assigned FROM {orders}""",
    "p_harsh_judgments": """SELECT event_id AS feedback_id, user_id AS source_id, ts AS judged_at, CASE event_type WHEN 'purchase' THEN 'LIKE' ELSE 'STRONG_PASS' END AS verdict FROM {events} WHERE event_id % 4 = 0""",
    "p_answers": """SELECT concat('r', cast(l_orderkey * 8 + l_linenumber AS varchar(20))) AS message_id, l_orderkey AS delivery_id, min(l_partkey) % 50 AS tk, (l_orderkey + l_linenumber) % 5 AS form,
 concat(CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'LIKE' WHEN 1 THEN concat('tk', cast(min(l_partkey) % 50 AS varchar(20)), ' - PASS') WHEN 2 THEN concat('$TK', cast(min(l_partkey) % 50 AS varchar(20)), ': strong like') WHEN 3 THEN 'nothing here' ELSE 'ZZZ -- maybe' END,
 chr(10), 'so it is ', cast(l_linenumber AS varchar(20)), chr(10)) AS body, l_linenumber AS line FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "p_blind_answers": """SELECT concat('b', cast(p_partkey AS varchar(20))) AS message_id, p_partkey AS ref, p_partkey + 7 AS next_ref,
 concat('BR-', cast(p_partkey AS varchar(20)), ' - LIKE', chr(10), p_name, chr(10), 'br-', cast(p_partkey + 7 AS varchar(20)), ': strong pass', chr(10)) AS body, p_name FROM {part}""",
    "p_screen_answers": """SELECT concat('s', cast(event_id AS varchar(20))) AS message_id, event_id AS ref, concat('SR-', cast(event_id AS varchar(20)), CASE event_id % 6 WHEN 5 THEN ' - perhaps' ELSE ': maybe.' END, chr(10), event_type) AS body, event_type FROM {events}""",
    "p_mail": """SELECT concat('m', cast(o_orderkey AS varchar(20))) AS message_id, concat('t', cast(o_custkey AS varchar(20))) AS thread_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Eve <eve@x.org>' WHEN o_orderkey % 2 = 0 THEN 'JOE@x.org' ELSE 'Joe <joe@X.org>' END AS sender,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'AUTHENTICATED' END AS sender_authenticated, CASE o_orderkey % 6 WHEN 0 THEN 'Re: Fwd: quillstone blind review' WHEN 1 THEN 'quillstone  Screen Review' WHEN 2 THEN 'Re: RE: quillstone — new ideas worth attention, 1 May' WHEN 3 THEN 'new ideas worth attention' ELSE NULL END AS subject FROM {orders}""",
    "p_fetched": """SELECT 'catalog' AS source_name, cast(floor(p_partkey / 2) AS bigint) AS external_id, concat('h', cast(p_partkey % 2 * 3 + p_partkey % 3 AS varchar(20))) AS content_hash, p_partkey % 2 = 0 AS content_complete FROM {part}""",
    "p_reviewed": """SELECT p_partkey AS feedback_id, CASE WHEN p_partkey % 5 = 0 THEN 'candidate' ELSE 'official' END AS role, CASE p_size % 4 WHEN 0 THEN 'LIKE' WHEN 1 THEN 'MAYBE' WHEN 2 THEN 'PASS' ELSE NULL END AS verdict,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS assignment_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('$t', cast(cast(floor(p_partkey / 3) AS bigint) AS varchar(20))) END AS ticker,
 CASE WHEN p_partkey % 7 < 2 THEN concat('House, ', cast(cast(floor(p_partkey / 5) AS bigint) AS varchar(20))) ELSE NULL END AS company, p_size % 9 = 0 AS doubtful FROM {part}""",
    "p_exposures": """SELECT l_orderkey * 8 + l_linenumber AS feedback_id, min(l_partkey) AS source_id, (min(l_partkey) * 7) % (SELECT count(*) FROM {part}) AS screened_source_id FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING min(l_returnflag) NOT IN ('A', 'N')""",
}


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One projection over the parquet tables of sf_dir."""
    text = PROJECTIONS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", text)})


def with_projections(query: str) -> str:
    """DuckDB SQL: the query with the projections it names as common table expressions."""
    names = [n for n in PROJECTIONS if re.search(rf"\b{n}\b", query)]
    if not names:
        return query
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', PROJECTIONS[n])})" for n in names)
    recursive, rest = re.match(r"\s*(?:WITH\s+(RECURSIVE\s+)?)?(.*)", query, re.S).groups()
    own = re.match(r"\s*WITH\b", query) is not None
    return f"WITH {recursive or ''}{ctes}{', ' if own else ' '}{rest}"
