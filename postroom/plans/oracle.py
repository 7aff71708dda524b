"""DuckDB SQL for the queries of the catalogue, over the same tables."""

from __future__ import annotations

from postroom.plans.catalogue import MAIL, PEOPLE

_BLANK = r"[ \t\n\r\f\v]"

_COPIES = r"""
copies AS (SELECT doc_id, lang, source AS mailbox_key, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS source_file,
  sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS canonical_hash FROM documents)
"""

_HEADERS = """
h AS (SELECT 'ann-b' || (user_id % 20) AS mailbox, event_id AS seq, 'f' || (event_id % 3) AS folder_name,
  CASE WHEN event_id % 4 = 0 THEN 'abee' || (user_id % 3) || ' (Non-Privileged).pst' END AS x_filename,
  ['Ann Bee', 'Carl Dee', 'Eve Fox', 'Gus Hay'][event_id % 4 + 1] AS from_name,
  CASE WHEN user_id % 17 <> 0 THEN ['ann.bee@corp.com', 'cdee@corp.com', 'eve.fox@ext.org', 'info@corp.com', 'abee@ext.org'][(event_id * user_id) % 5 + 1] END AS from_email,
  CASE WHEN event_id % 3 = 0 THEN ['Ann Bee', 'Carl Dee', 'Eve Fox', 'Gus Hay'][user_id % 4 + 1] END AS x_from_name,
  ['ann.bee@corp.com', 'cdee@corp.com', 'eve.fox@ext.org', 'info@corp.com', 'abee@ext.org'][user_id % 5 + 1] AS contact FROM events),
seen AS (SELECT mailbox, from_email AS email, seq * 1000 AS tick FROM h WHERE from_email IS NOT NULL UNION ALL SELECT mailbox, contact, seq * 1000 + 2 FROM h),
named AS (SELECT mailbox, email, name, count(*) AS n, min(tick) AS first FROM (
  SELECT mailbox, from_email AS email, from_name AS name, seq * 1000 AS tick FROM h WHERE from_email IS NOT NULL
  UNION ALL SELECT mailbox, from_email, x_from_name, seq * 1000 + 1 FROM h WHERE from_email IS NOT NULL AND x_from_name IS NOT NULL) GROUP BY ALL)
"""

_OWNERS = (
    _HEADERS
    + """,
fe AS (SELECT mailbox, from_email AS email, count(*) AS n, min(seq) AS first FROM h WHERE from_email IS NOT NULL GROUP BY ALL),
fn AS (SELECT mailbox, from_name AS name, count(*) AS n FROM h GROUP BY ALL),
xf AS (SELECT mailbox, x_from_name AS name, count(*) AS n FROM h WHERE x_from_name IS NOT NULL GROUP BY ALL),
hints AS (SELECT mailbox, list(DISTINCT 'abee') AS hints FROM h WHERE x_filename IS NOT NULL GROUP BY mailbox),
top_name AS (SELECT mailbox, email, name FROM named QUALIFY row_number() OVER (PARTITION BY mailbox, email ORDER BY n DESC, first) = 1),
derived AS (SELECT * FROM (VALUES ('ann.bee@corp.com', 'Ann Bee'), ('cdee@corp.com', 'Cdee'), ('eve.fox@ext.org', 'Eve Fox'), ('info@corp.com', NULL), ('abee@ext.org', 'Abee')) AS t(email, name)),
cand AS (SELECT e.mailbox, e.email, coalesce(t.name, d.name) AS name FROM (SELECT DISTINCT mailbox, email FROM seen) e LEFT JOIN top_name t USING (mailbox, email) LEFT JOIN derived d ON e.email = d.email),
facts AS (SELECT c.*, split_part(c.email, '@', 1) AS loc, coalesce(fe.n, 0) AS fh, fe.n IS NULL AS later, coalesce(fn.n, 0) AS nh, coalesce(xf.n, 0) AS xh, coalesce(hints.hints, []) AS hints,
    list_filter(regexp_extract_all(lower(coalesce(c.name, '')), '[a-z]+'), lambda t: length(t) >= 2) AS nt, list_filter(regexp_extract_all(split_part(c.email, '@', 1), '[a-z]+'), lambda t: length(t) >= 2) AS et, ['ann'] AS ot
  FROM cand c LEFT JOIN fe USING (mailbox, email) LEFT JOIN fn ON fn.mailbox = c.mailbox AND fn.name = c.name LEFT JOIN xf ON xf.mailbox = c.mailbox AND xf.name = c.name LEFT JOIN hints ON hints.mailbox = c.mailbox),
kinds AS (SELECT *, CASE WHEN loc = 'info' THEN 'system' WHEN len(list_distinct(nt)) >= 2 THEN 'person' WHEN contains(loc, '.') AND len(et) >= 2 THEN 'likely_person' ELSE 'unknown' END AS kind,
    (list_has_any(ot, nt) OR list_has_any(ot, et)) AS om, (list_has_any(hints, nt) OR list_has_any(hints, et)) AS fm FROM facts),
scored AS (SELECT *, ln(1 + fh) * 12.0 + ln(1 + nh) * 5.0 + ln(1 + xh) * 8.0 + CASE WHEN email LIKE '%@corp.com' THEN 8.0 ELSE 0.0 END
    + CASE WHEN om AND fm THEN 30.0 WHEN om OR fm THEN 12.0 ELSE 0.0 END
    + CASE WHEN list_has_any(ot, nt) THEN 20.0 ELSE 0.0 END + CASE WHEN list_has_any(ot, et) THEN 20.0 ELSE 0.0 END
    + CASE WHEN list_has_any(hints, nt) THEN 18.0 ELSE 0.0 END + CASE WHEN list_has_any(hints, et) THEN 18.0 ELSE 0.0 END
    + CASE WHEN contains(loc, '.') THEN 4.0 ELSE 0.0 END
    + CASE kind WHEN 'person' THEN 20.0 WHEN 'likely_person' THEN 8.0 WHEN 'unknown' THEN -2.0 WHEN 'system' THEN -45.0 ELSE 0.0 END AS score FROM kinds),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY mailbox ORDER BY CASE kind WHEN 'person' THEN 0 WHEN 'likely_person' THEN 1 WHEN 'unknown' THEN 2 WHEN 'system' THEN 4 END, score DESC, later, email) = 1),
dom AS (SELECT f.mailbox, f.email, t.name FROM (SELECT * FROM fe QUALIFY row_number() OVER (PARTITION BY mailbox ORDER BY n DESC, first) = 1) f LEFT JOIN top_name t USING (mailbox, email)),
domk AS (SELECT *, CASE WHEN email LIKE 'info@%' THEN 'system' WHEN len(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda t: length(t) >= 2)) >= 2 THEN 'person' ELSE 'unknown' END AS kind FROM dom),
boxes AS (SELECT mailbox, count(*) AS message_count, count(DISTINCT folder_name) AS folder_count FROM h GROUP BY mailbox),
owners AS (SELECT b.mailbox AS mailbox_owner, b.name AS inferred_display_name, b.email AS inferred_primary_email, b.kind AS inferred_identity_type, x.message_count, x.folder_count, b.fh AS top_from_email_count,
    round(b.score, 2) AS owner_confidence_score, CASE WHEN b.kind = 'system' THEN 'system' WHEN b.score >= 40 THEN 'high' WHEN b.score >= 18 THEN 'medium' ELSE 'low' END AS owner_confidence_label,
    d.email AS dominant_sender_email, (b.email IS DISTINCT FROM d.email OR b.kind IS DISTINCT FROM d.kind) AS owner_vs_sender_mismatch,
    (SELECT string_agg(DISTINCT s.email, ' | ' ORDER BY s.email) FROM seen s WHERE s.mailbox = b.mailbox) AS all_emails
  FROM best b JOIN boxes x USING (mailbox) LEFT JOIN domk d USING (mailbox))
"""
)

_ALIASES = (
    _OWNERS
    + """,
pairs AS (SELECT o.mailbox_owner, o.inferred_primary_email AS piv, o.inferred_display_name AS pname, o.dominant_sender_email AS sender, e.email AS cand, coalesce(d.name, o.inferred_display_name) AS cname, coalesce(hints.hints, []) AS hints
  FROM owners o JOIN (SELECT DISTINCT mailbox, email FROM seen) e ON e.mailbox = o.mailbox_owner LEFT JOIN derived d ON d.email = e.email LEFT JOIN hints ON hints.mailbox = o.mailbox_owner
  WHERE e.email IS DISTINCT FROM o.inferred_primary_email AND e.email NOT LIKE 'info@%'),
sets AS (SELECT *, regexp_replace(split_part(piv, '@', 1), '[^a-z0-9]', '', 'g') AS ps, regexp_replace(split_part(cand, '@', 1), '[^a-z0-9]', '', 'g') AS cs, regexp_replace(split_part(sender, '@', 1), '[^a-z0-9]', '', 'g') AS ss,
  list_distinct(list_filter(regexp_extract_all(lower(pname), '[a-z]+'), lambda t: length(t) >= 2)) AS pn, list_distinct(list_filter(regexp_extract_all(lower(cname), '[a-z]+'), lambda t: length(t) >= 2)) AS cn,
  list_distinct(list_filter(regexp_extract_all(split_part(cand, '@', 1), '[a-z]+'), lambda t: length(t) >= 2)) AS ct FROM pairs),
chars AS (SELECT *, list_distinct(string_split(ps, '')) AS pc, list_distinct(string_split(cs, '')) AS cc, list_distinct(string_split(ss, '')) AS sc FROM sets),
raw AS (SELECT *, len(list_intersect(pc, cc)) / (len(pc) + len(cc) - len(list_intersect(pc, cc))) AS l0, len(list_intersect(sc, cc)) / (len(sc) + len(cc) - len(list_intersect(sc, cc))) AS s0, len(list_intersect(pn, cn)) / (len(pn) + len(cn) - len(list_intersect(pn, cn))) AS n0 FROM chars),
sims AS (SELECT *, CASE WHEN ps = cs THEN 1.0 ELSE round(CASE WHEN contains(ps, cs) OR contains(cs, ps) THEN greatest(l0, 0.85) ELSE l0 END, 4) END::DOUBLE AS l, round(n0, 4)::DOUBLE AS n,
  CASE WHEN sender = cand OR ss = cs THEN 1.0 ELSE round(CASE WHEN contains(ss, cs) OR contains(cs, ss) THEN greatest(s0, 0.85) ELSE s0 END, 4) END::DOUBLE AS se,
  (CASE WHEN list_contains(cn, 'ann') THEN 0.5 ELSE 0 END + CASE WHEN list_contains(ct, 'ann') THEN 0.5 ELSE 0 END)::DOUBLE AS ow,
  (CASE WHEN list_has_any(hints, cn) THEN 0.5 ELSE 0 END + CASE WHEN list_has_any(hints, ct) THEN 0.5 ELSE 0 END)::DOUBLE AS xf,
  CASE WHEN split_part(piv, '@', 2) = split_part(cand, '@', 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS dm,
  CASE WHEN len(cn) >= 2 THEN 'person' WHEN contains(split_part(cand, '@', 1), '.') AND len(ct) >= 2 THEN 'likely_person' ELSE 'unknown' END AS kind FROM raw),
gated AS (SELECT * FROM sims WHERE NOT (l < 0.45 AND n < 0.45 AND ow = 0 AND xf = 0 AND se < 0.6)),
points AS (SELECT *, round(greatest(0.0, least(100.0, l * 35.0 + n * 25.0 + ow * 15.0 + xf * 15.0 + dm * 5.0 + se * 5.0 + CASE WHEN cand NOT LIKE '%@corp.com' AND l >= 0.75 THEN 5.0 ELSE 0.0 END + CASE kind WHEN 'person' THEN 5.0 WHEN 'likely_person' THEN 2.0 ELSE -3.0 END)), 2)::DOUBLE AS score FROM gated),
aliases AS (SELECT mailbox_owner, piv AS pivot_email, cand AS candidate_email, l AS localpart_similarity_score, n AS name_similarity_score, score AS final_alias_score,
  CASE WHEN score >= 70 THEN 'strong_alias' WHEN score >= 45 THEN 'possible_alias' WHEN score >= 25 THEN 'unlikely_alias' ELSE 'not_alias' END AS alias_label,
  concat_ws(' | ', CASE WHEN l >= 0.95 THEN 'localpart quasi identique' WHEN l >= 0.75 THEN 'localpart proche' END, CASE WHEN n >= 0.95 THEN 'nom quasi identique' WHEN n >= 0.75 THEN 'nom proche' END,
    CASE WHEN ow >= 1 THEN 'fort alignement mailbox_owner' WHEN ow > 0 THEN 'alignement mailbox_owner' END, CASE WHEN xf >= 1 THEN 'fort alignement X-FileName' WHEN xf > 0 THEN 'alignement X-FileName' END,
    CASE WHEN dm >= 1 THEN 'même domaine' END, CASE WHEN se >= 1 THEN 'même sender dominant' WHEN se >= 0.75 THEN 'sender dominant proche' END, CASE kind WHEN 'person' THEN 'profil personne' WHEN 'likely_person' THEN 'profil probablement personne' END) AS alias_reasons FROM points)
"""
)

_THREADED = """
m AS (SELECT event_id AS id, '<' || event_id || '@t>' AS message_id, 'u' || (user_id % 50) AS sender, CASE WHEN event_id % 97 <> 0 THEN ts END AS sent_at,
  CASE WHEN event_id % 3 = 0 THEN 'rare ' || (user_id % 50 % 10) || '.' || (event_id // 3 % 60) ELSE event_type || ' ' || (user_id % 50 % 10) END AS subject,
  ['u' || ((user_id % 50 * 11 + 10) % 50), 'u' || ((user_id % 50 * 7 + 3) % 50)] AS recipients,
  CASE WHEN event_id % 40 = 0 THEN '<' || (event_id - 7) || '@t>' END AS in_reply_to, event_id % 2 = 0 AS is_response FROM events),
met AS (SELECT a.id, c.id AS parent_id, c.message_id AS parent, 45 + CASE WHEN list_contains(a.recipients, c.sender) THEN 25 ELSE 0 END + CASE WHEN list_contains(c.recipients, a.sender) THEN 20 ELSE 0 END
    + CASE WHEN (epoch_us(a.sent_at) - epoch_us(c.sent_at)) / 1e6 <= 3600 THEN 10 WHEN (epoch_us(a.sent_at) - epoch_us(c.sent_at)) / 1e6 <= 86400 THEN 6 WHEN (epoch_us(a.sent_at) - epoch_us(c.sent_at)) / 1e6 <= 7 * 86400 THEN 3 ELSE 0 END AS score, c.sent_at AS tick
  FROM m a JOIN m c ON a.subject = c.subject AND a.id <> c.id AND c.sent_at < a.sent_at AND c.sent_at >= a.sent_at - INTERVAL 30 DAY WHERE a.is_response),
guess AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, tick, parent_id) = 1)
"""

_PLAIN_REFERENCES = "r AS (SELECT event_id AS id, 0 AS pos, '<' || (event_id - 1) || '@t>' AS ref FROM events WHERE event_id % 50 = 1 UNION ALL SELECT event_id, 2, '<' || (event_id + 1) || '@t>' FROM events WHERE event_id % 50 = 1)"

_PLACED = """
byref AS (SELECT r.id, arg_max(ref, pos) AS parent, arg_min(ref, pos) AS root, count(*) AS depth FROM r WHERE ref IN (SELECT message_id FROM m) GROUP BY 1),
s AS (SELECT m.id, m.message_id, m.sent_at, CASE WHEN b.id IS NOT NULL THEN 'references' WHEN k.id IS NOT NULL THEN 'in_reply_to' WHEN g.id IS NOT NULL THEN 'heuristic' ELSE 'self_rooted' END AS kind, b.parent AS bp, b.root AS br, b.depth AS bd, k.message_id AS kp, k.id AS kid, k.sent_at AS kat, g.parent AS gp
  FROM m LEFT JOIN byref b ON m.id = b.id LEFT JOIN m k ON m.in_reply_to = k.message_id LEFT JOIN guess g ON m.id = g.id),
d AS (SELECT id, kind, sent_at, message_id, CASE kind WHEN 'references' THEN bp WHEN 'in_reply_to' THEN kp WHEN 'heuristic' THEN gp END AS parent, CASE kind WHEN 'references' THEN br WHEN 'in_reply_to' THEN kp WHEN 'heuristic' THEN gp ELSE message_id END AS root_id, CASE kind WHEN 'references' THEN bd WHEN 'self_rooted' THEN 0 ELSE 1 END AS depth,
  CASE WHEN kind = 'in_reply_to' AND ((sent_at IS NOT NULL AND kat IS NULL) OR coalesce(kat > sent_at, FALSE) OR (sent_at IS NOT DISTINCT FROM kat AND kid < id)) THEN kid END AS follow FROM s)
"""

SQL: dict[str, str] = {
    "mails_per_month": "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_is_response, count(*) FILTER (o_orderstatus = 'O') AS n_is_forward FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1",
    "dashboard_summary": f"""WITH {MAIL}, c AS (SELECT count(*) AS messages, count(*) FILTER (coalesce(response_to_message_id, '') <> '') AS with_parent, count(*) FILTER (parse_ok) AS parse_ok, count(*) FILTER (has_attachments) AS with_attachments, count(*) FILTER (is_response) AS responses, count(*) FILTER (is_forward) AS forwards FROM mail)
SELECT *, coalesce(round(with_parent * 100.0::DOUBLE / nullif(messages, 0), 2), 0.0) AS with_parent_rate, coalesce(round(parse_ok * 100.0::DOUBLE / nullif(messages, 0), 2), 0.0) AS parse_ok_rate, coalesce(round(with_attachments * 100.0::DOUBLE / nullif(messages, 0), 2), 0.0) AS with_attachments_rate,
 coalesce(round(responses * 100.0::DOUBLE / nullif(messages, 0), 2), 0.0) AS responses_rate, coalesce(round(forwards * 100.0::DOUBLE / nullif(messages, 0), 2), 0.0) AS forwards_rate,
 greatest(0.0::DOUBLE, round(100 - coalesce(round(with_attachments * 100.0::DOUBLE / nullif(messages, 0), 2), 0.0), 2)) AS without_attachments_rate FROM c""",
    "top_senders": f"WITH {MAIL} SELECT sender_email, count(*) AS n FROM mail GROUP BY 1 ORDER BY n DESC, sender_email ASC NULLS LAST LIMIT 10",
    "top_domains": f"WITH {MAIL} SELECT coalesce(nullif(split_part(sender_email, '@', 2), ''), '(unknown)') AS domain, count(*) AS n FROM mail GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "top_mailboxes": "SELECT source AS mailbox, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "top_folders": "SELECT concat_ws('/', source, lang) AS folder_path, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "hourly_distribution": f"WITH {MAIL} SELECT hour(sent_at) AS hour, count(*) AS n FROM mail WHERE sent_at IS NOT NULL GROUP BY 1",
    "weekday_distribution": f"WITH {MAIL} SELECT dayofweek(sent_at) + 1 AS weekday, count(*) AS n FROM mail WHERE sent_at IS NOT NULL GROUP BY 1",
    "attachment_distribution": f"WITH {MAIL} SELECT attachment_count AS attachments, count(*) AS n FROM mail GROUP BY 1 ORDER BY 1 LIMIT 15",
    "depth_distribution": f"WITH {MAIL} SELECT references_depth AS depth, count(*) AS n FROM mail GROUP BY 1 ORDER BY 1 LIMIT 15",
    "quoted_distribution": f"WITH {MAIL} SELECT quoted_line_count AS quoted, count(*) AS n FROM mail GROUP BY 1 ORDER BY 1 LIMIT 20",
    "quality_stats": f"WITH {MAIL} SELECT count(*) FILTER (coalesce(sender_email, '') = '') AS without_sender, count(*) FILTER (sent_at IS NULL) AS without_date, count(*) FILTER (coalesce(message_id, '') = '') AS without_message_id, count(*) FILTER (coalesce(subject_normalized, '') = '') AS without_subject, count(*) FILTER (NOT parse_ok) AS parse_errors FROM mail",
    "collaborator_list": f"WITH {PEOPLE} SELECT n.n_name AS employee_key, n.n_name AS display_name, count(DISTINCT a.email) AS email_count, coalesce(string_agg(DISTINCT a.email, ', ' ORDER BY a.email), '') AS emails FROM nation n LEFT JOIN addr a ON a.employee_key = n.n_name GROUP BY 1, 2",
    "collaborator_search": f"WITH {PEOPLE} SELECT n.n_name AS employee_key, n.n_name AS display_name, count(DISTINCT a.email) AS email_count, coalesce(string_agg(DISTINCT a.email, ', ' ORDER BY a.email), '') AS emails FROM nation n LEFT JOIN addr a ON a.employee_key = n.n_name GROUP BY 1, 2 HAVING contains(upper(n.n_name), 'CUSTOMER.00000001') OR bool_or(contains(upper(a.email), 'CUSTOMER.00000001'))",
    "folder_detail": "SELECT o_orderkey AS canonical_hash, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS sent_at, o_custkey AS sender, CAST(o_orderkey AS VARCHAR) AS source_file FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "message_details": """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_returnflag AS f, 's' || l_suppkey || '@corp.com' AS email FROM lineitem)
SELECT k, coalesce(string_agg(email, ',' ORDER BY pos, email) FILTER (f = 'A'), '') AS "to", coalesce(string_agg(email, ',' ORDER BY pos, email) FILTER (f = 'N'), '') AS cc, coalesce(string_agg(email, ',' ORDER BY pos, email) FILTER (f NOT IN ('A', 'N')), '') AS bcc, count(*) AS n FROM l GROUP BY k""",
    "sent_messages": "SELECT 'c' || o_custkey AS sender_email, CAST(o_orderkey AS VARCHAR) AS message_id, CAST(o_orderdate AS TIMESTAMP) AS sent_at FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "thread_view": "SELECT conv_id * 1000 + turn AS id, 'm' || conv_id || '.' || turn AS message_id, 'm' || conv_id || '.0' AS root, role FROM conversations WHERE conv_id = 1",
    "message_search_facets": f"WITH {MAIL} SELECT id, message_id, sender_email, references_depth, quoted_line_count FROM mail WHERE contains(upper(sender_email), 'CORP') AND sent_at >= TIMESTAMP '2024-01-01' AND is_response AND NOT has_attachments AND coalesce(body_html_clean, '') = '' AND attachment_count <= 5 AND references_depth >= 1 AND quoted_line_count <= 7 ORDER BY sent_at DESC NULLS FIRST, message_id LIMIT 200",
    "search_boolean": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id FROM t WHERE list_contains(w, 'ea') OR list_contains(w, 'tionthen') OR (list_contains(w, 'worthless') AND NOT list_contains(w, 'idiot'))""",
    "index_dictionary": r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: w <> '')) AS w FROM documents)
SELECT lower(w) AS word, count(DISTINCT doc_id) AS texts, count(*) AS words FROM t WHERE lower(w) NOT IN ('and', 'of', 'the') GROUP BY 1""",
    "collated_names": """WITH c AS (SELECT c_custkey, c_nationkey, ['zebra', 'Äpfel', 'apple', 'Apple', 'éclair', 'Eclair', 'ecole', 'École', 'Ärger', 'o''neil', 'oneil', 'ça', 'ca'][c_custkey % 13 + 1] AS name FROM customer)
SELECT c_custkey, name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY name COLLATE en, c_custkey) AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY name COLLATE en DESC, c_custkey) AS INTEGER) AS from_end FROM c""",
    "folder_page": f"""WITH {PEOPLE}, m AS (SELECT *, 'customer.' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') || '@corp.com' AS sender_email FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT o_orderkey AS canonical_hash, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS sent_at, '1-urgent' AS folder_name, 'FRANCE' AS owner, (SELECT n_name FROM nation WHERE n_name = 'FRANCE') AS owner_name, m.sender_email, a.employee_key AS sender_key, a.employee_key AS sender_name FROM m LEFT JOIN addr a ON a.email = m.sender_email""",
    "owner_counts": f"""WITH {_HEADERS},
t AS (SELECT mailbox, 'from_email' AS counter, from_email AS a, NULL AS b, seq * 1000 AS tick FROM h UNION ALL SELECT mailbox, 'from_name', from_name, NULL, seq * 1000 FROM h UNION ALL SELECT mailbox, 'xfrom', x_from_name, NULL, seq * 1000 FROM h
  UNION ALL SELECT mailbox, 'x_filename', x_filename, NULL, seq * 1000 FROM h UNION ALL SELECT mailbox, 'title', 'Trader', NULL, seq * 1000 FROM h WHERE seq % 10 = 0 UNION ALL SELECT mailbox, 'emails', email, NULL, tick FROM seen)
SELECT mailbox, counter, a, CAST(b AS VARCHAR) AS b, CAST(count(*) AS BIGINT) AS n, min(tick) AS first FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3, 4 UNION ALL SELECT mailbox, 'names', email, name, n, first FROM named""",
    "dashboard_board": f"""WITH {MAIL}, k AS (SELECT *, CASE WHEN contains(sender_email, '@') THEN split_part(sender_email, '@', 2) END AS domain, strftime(date_trunc('month', sent_at), '%Y-%m') AS month FROM mail),
s AS (SELECT 'months' AS section, month AS value, count(*) AS n, count(*) FILTER (is_response) AS responses, count(*) FILTER (is_forward) AS forwards FROM k WHERE month IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'hours', lpad(CAST(hour(sent_at) AS VARCHAR), 2, '0'), count(*), count(*) FILTER (is_response), count(*) FILTER (is_forward) FROM k WHERE sent_at IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'weekdays', CAST(dayofweek(sent_at) + 1 AS VARCHAR), count(*), count(*) FILTER (is_response), count(*) FILTER (is_forward) FROM k WHERE sent_at IS NOT NULL GROUP BY 2),
l AS (SELECT 'senders' AS section, sender_email AS value, count(*) AS n, count(*) FILTER (is_response) AS responses, count(*) FILTER (is_forward) AS forwards FROM k GROUP BY 2 UNION ALL SELECT 'domains', domain, count(*), count(*) FILTER (is_response), count(*) FILTER (is_forward) FROM k GROUP BY 2),
b AS (SELECT 'attachments' AS section, attachment_count AS v, count(*) AS n, count(*) FILTER (is_response) AS responses, count(*) FILTER (is_forward) AS forwards FROM k GROUP BY 2 UNION ALL SELECT 'depths', references_depth, count(*), count(*) FILTER (is_response), count(*) FILTER (is_forward) FROM k GROUP BY 2
  UNION ALL SELECT 'quoted', quoted_line_count, count(*), count(*) FILTER (is_response), count(*) FILTER (is_forward) FROM k GROUP BY 2),
r AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY n DESC, value ASC NULLS LAST) AS place, value, n, responses, forwards FROM l QUALIFY place <= 10
  UNION ALL SELECT section, row_number() OVER (PARTITION BY section ORDER BY v) AS place, CAST(v AS VARCHAR), n, responses, forwards FROM b QUALIFY place <= CASE section WHEN 'quoted' THEN 20 ELSE 15 END),
t AS (SELECT count(*) AS messages, count(*) FILTER (coalesce(response_to_message_id, '') <> '') AS with_parent, count(*) FILTER (parse_ok) AS parse_ok, count(*) FILTER (has_attachments) AS with_attachments, count(*) FILTER (is_response) AS responses, count(*) FILTER (is_forward) AS forwards,
  count(*) FILTER (coalesce(sender_email, '') = '') AS without_sender, count(*) FILTER (sent_at IS NULL) AS without_date, count(*) FILTER (coalesce(message_id, '') = '') AS without_message_id, count(*) FILTER (coalesce(subject_normalized, '') = '') AS without_subject, count(*) FILTER (NOT parse_ok) AS parse_errors FROM mail),
u AS (UNPIVOT t ON * INTO NAME value VALUE n)
SELECT section, NULL AS place, value, n, responses, forwards, NULL AS rate FROM s
UNION ALL SELECT section, CAST(place AS INTEGER), CASE WHEN section = 'domains' THEN coalesce(nullif(value, ''), '(unknown)') ELSE value END, n, responses, forwards, NULL FROM r
UNION ALL SELECT CASE WHEN value IN ('messages', 'with_parent', 'parse_ok', 'with_attachments', 'responses', 'forwards') THEN 'totals' ELSE 'quality' END, NULL, value, n, NULL, NULL, coalesce(round(n * 100.0::DOUBLE / nullif((SELECT messages FROM t), 0), 2), 0.0) FROM u""",
    "dedupe_canonical": f"WITH {_COPIES} SELECT doc_id, mailbox_key, canonical_hash FROM copies QUALIFY row_number() OVER (PARTITION BY canonical_hash ORDER BY mailbox_key, source_file) = 1",
    "occurrences": f"WITH {_COPIES} SELECT canonical_hash, count(*) AS occurrences, count(DISTINCT mailbox_key) AS mailboxes FROM copies GROUP BY 1 HAVING count(*) > 1",
    "content_hashes": f"WITH {MAIL} SELECT id, sha256(coalesce(sender_email, '') || chr(10) || lower(subject_normalized) || chr(10) || coalesce(lower(trim(regexp_replace(body_clean, '[ \\t\\n\\r]+', ' ', 'g'))), '')) AS content_hash FROM mail",
    "canonical_hashes": r"""WITH r AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'N' THEN 'cc' ELSE 'to' END || ':s' || l_suppkey || '@corp.com', chr(10) ORDER BY CASE WHEN l_returnflag = 'N' THEN 'cc' ELSE 'to' END || ':s' || l_suppkey || '@corp.com') AS people FROM lineitem GROUP BY 1)
SELECT o_orderkey, sha256(concat_ws(chr(10) || chr(10), 'sender=c' || o_custkey || '@corp.com', 'sent_at=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00', 'subject=' || lower(o_orderpriority), 'body=' || lower(o_orderstatus), 'recipients=' || chr(10) || people, 'references=' || chr(10) || '<' || o_custkey || '@x>', 'attachments=' || chr(10) || 'a.pdf|application/pdf|3|')) AS canonical_hash FROM orders JOIN r ON o_orderkey = l_orderkey""",
    "upsert_addresses": f"WITH {MAIL} SELECT sender_email AS email, split_part(sender_email, '@', 1) AS local_part, split_part(sender_email, '@', 2) AS domain, arg_min('n' || id, id) FILTER (id % 3 = 0) AS display_name FROM mail WHERE sender_email IS NOT NULL GROUP BY 1, 2, 3",
    "upsert_folders": f"WITH {_COPIES} SELECT mailbox_key, lang AS folder_path, coalesce(arg_max('f' || doc_id, doc_id) FILTER (doc_id % 2 = 0), lang) AS folder_name, 't' || max(doc_id) AS folder_type FROM copies GROUP BY 1, 2",
    "explode_recipients": "SELECT o_orderkey AS canonical_hash, unnest(['a' || (o_custkey % 5) || '@x.org', 'b@corp.com']) AS email, unnest([0, 1])::BIGINT AS pos FROM orders",
    "explode_references": """WITH r AS (SELECT o_orderkey AS k, ['<a' || (o_custkey % 5) || '@x>', '<b@y>', '<a' || (o_orderkey % 5) || '@x>'] AS r FROM orders),
d AS (SELECT k, CASE WHEN r[3] = r[1] THEN r[1:2] ELSE r END AS r FROM r) SELECT k AS canonical_hash, r[i] AS referenced_message_id, i - 1 AS pos FROM d, unnest(range(1, len(r) + 1)) AS t(i)""",
    "upsert_snapshot": "SELECT o_orderkey AS source_file, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'new' END AS v FROM orders",
    "normalize_text": "SELECT c_custkey, replace(c_name, '#', ' ') AS normal FROM customer",
    "normalize_subject": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'aw: ' ELSE '' END || lower(c_mktsegment) AS subject, c_custkey % 4 = 0 AS reply, c_custkey % 4 = 1 AS forward FROM customer",
    "message_ids": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '<a' || c_custkey || '@x.org>' ELSE 'a' || c_custkey || '@x.org' END AS message_id FROM customer",
    "address_parts": f"WITH {MAIL} SELECT id, nullif(split_part(sender_email, '@', 1), '') AS local_part, nullif(split_part(sender_email, '@', 2), '') AS domain, split_part(sender_email, '@', 2) = 'corp.com' AS internal FROM mail",
    "salvage_address": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) || '@corp.com' WHEN 1 THEN '12152@corp.com' WHEN 2 THEN 'a.b-' || c_custkey || '@x.org' WHEN 3 THEN NULL ELSE 'b@c.org' END AS address FROM customer",
    "extract_addresses": r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._%+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,}'))) AS address FROM documents WHERE contains(text, '@')",
    "parse_dates": "SELECT event_id, date_trunc('second', ts) + INTERVAL 7 HOUR AS sent_at FROM events",
    "clean_bodies": "SELECT c_custkey, 'Hi ' || c_name || repeat(chr(10), 4) || '> quoted' || chr(10) || '  > more' || chr(10) || '> ' || c_mktsegment AS body, 'Hi ' || c_name || chr(10) || chr(10) || '> quoted' || chr(10) || '  > more' || chr(10) || '> ' || c_mktsegment AS clean, substr('Hi ' || c_name, 1, 12) AS snippet, 3 AS quoted FROM customer",
    "keyword_lists": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), ' +'), lambda x: length(x) >= 4)) AS word FROM documents),
n AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ('this', 'that', 'with', 'have', 'from', 'your', 'will', 'would', 'there', 'their', 'about', 'please', 'thanks', 'thank', 'subject', 'message', 'forward', 'regards') GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank, word, n FROM n QUALIFY rank <= 10""",
    "looks_like_html": r"""WITH b AS (SELECT page_id, html AS t FROM pages UNION ALL SELECT -page_id - 1, url FROM pages), s AS (SELECT page_id, substr(t, 1, 10000) AS t FROM b)
SELECT page_id, regexp_matches(t, '(?is)<\s*(html|body|head|meta|table|tr|td|div|span|font|p|br)\b|</?(html|body|div|span|table|tr|td|font|p|br|a)\b') OR len(regexp_extract_all(t, '<[a-zA-Z][^>]{0,200}>')) >= 2 OR regexp_matches(t, '&nbsp;|&lt;|&gt;|&amp;|&#\d+;') AS is_html FROM s""",
    "html_to_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) AS text FROM c""",
    "html_sanitize": r"""SELECT c_custkey, '<p>' || c_name || '</p><a href=\"#\">z</a>' AS html FROM customer""",
    "folder_types": """WITH f AS (SELECT c_custkey, c_name, c_custkey % 16 AS i FROM customer)
SELECT c_custkey, ['inbox', 'sent mail', 'sent items', 'deleted items', 'all documents', 'notes inbox', 'discussion threads', 'to do', 'calendar', 'legal work', 'ferc', 'west bank', 'power deals', 'family', 'it stuff', 'misc'][i + 1] AS key,
 ['inbox', 'sent', 'sent', 'deleted', 'archive', 'notes', 'discussion', 'tasks', 'calendar', 'legal work', 'ferc', 'west bank', 'power deals', 'family', 'it stuff', 'misc'][i + 1] AS type,
 [NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'legal', 'regulation', 'bank', 'energy', 'personal', 'it', NULL][i + 1] AS topic, replace(lower(c_name), '#', '_') AS mailbox_key FROM f""",
    "folder_paths": "SELECT c_custkey, ['.', 'inbox', 'a_b/Deep Legal'][c_custkey % 3 + 1] AS path, ['', 'inbox', 'Deep Legal'][c_custkey % 3 + 1] AS name, [NULL, NULL, 'legal'][c_custkey % 3 + 1] AS topic, ['1.', 'inbox', 'a_b'][c_custkey % 3 + 1] AS first, ['1.', 'inbox', 'a_b/Deep Legal'][c_custkey % 3 + 1] AS below, [1, 1, 2][c_custkey % 3 + 1] AS depth FROM customer",
    "name_parts": "SELECT c_custkey, ['Jane', 'O''Brien-Smith', NULL, 'Ann'][c_custkey % 4 + 1] AS first, ['Doe', 'Pat', NULL, NULL][c_custkey % 4 + 1] AS last, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Jones' AS derived FROM customer",
    "identity_classes": "WITH k AS (SELECT c_custkey, c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'external_bulk' WHEN 2 THEN 'corporate' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'person' ELSE 'likely_person' END ELSE CASE WHEN c_custkey % 2 = 0 THEN 'person' ELSE 'unknown' END END AS kind FROM customer) SELECT c_custkey, kind, CASE kind WHEN 'person' THEN 0 WHEN 'likely_person' THEN 1 WHEN 'unknown' THEN 2 WHEN 'corporate' THEN 3 WHEN 'system' THEN 4 ELSE 5 END AS priority, CASE WHEN c_custkey % 3 = 0 THEN 'President,Vice President' ELSE 'CEO,Trader' END AS titles FROM k",
    "thread_infer": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '<p' || c_custkey || '@x>' END AS reply, c_custkey % 5 = 0 AS refs, c_custkey % 4 = 0 AS re, c_custkey % 4 = 1 AS fw, c_custkey % 7 = 0 AS q FROM customer),
p AS (SELECT *, coalesce(reply, CASE WHEN refs THEN '<s' || k || '@x>' END) AS parent FROM c),
s AS (SELECT *, CASE WHEN reply IS NOT NULL THEN 700 ELSE 0 END + CASE WHEN refs THEN 160 ELSE 0 END + CASE WHEN re THEN 50 ELSE 0 END + CASE WHEN q THEN 120 ELSE 0 END AS n FROM p),
f AS (SELECT *, CASE WHEN parent IS NULL AND (re OR q) THEN greatest(n, 350) ELSE n END AS n2 FROM s)
SELECT k AS c_custkey, parent IS NOT NULL OR re AS is_response, parent IS NOT NULL OR re OR q AS looks_like_response, fw AS is_forward, parent AS response_to_message_id, CASE WHEN reply IS NOT NULL THEN 'in_reply_to' WHEN refs THEN 'references' END AS response_to_message_id_source,
 CASE WHEN refs THEN '<r@x>' ELSE coalesce(reply, '<m' || k || '@x>') END AS thread_root_message_id, CASE WHEN refs THEN 2 ELSE 0 END AS references_depth, CASE WHEN q THEN 2 ELSE 0 END AS quoted_line_count,
 least(CASE WHEN parent IS NULL AND fw THEN least(n2, 400) ELSE n2 END, 1000) / 1000.0::DOUBLE AS confidence FROM f""",
    "thread_candidates": f"WITH {_THREADED} SELECT id, parent_id, score FROM guess",
    "thread_resolve": f"""WITH RECURSIVE {_THREADED}, {_PLAIN_REFERENCES}, {_PLACED},
w AS (SELECT id, follow, root_id, 0 AS n FROM d UNION ALL SELECT w.id, d.follow, d.root_id, n + 1 FROM w JOIN d ON w.follow = d.id),
e AS (SELECT id, arg_max(root_id, n) AS root_id FROM w GROUP BY 1)
SELECT d.id, d.kind, d.parent, e.root_id, CAST(d.depth AS INTEGER) AS depth FROM d JOIN e ON d.id = e.id""",
    "thread_resolve_fixpoint": f"""WITH RECURSIVE {_THREADED}, {_PLAIN_REFERENCES.replace("r AS", "r0 AS")},
r AS (SELECT * FROM r0 UNION ALL SELECT event_id, 5, '<' || (event_id + CASE event_id % 60 WHEN 7 THEN 2 WHEN 9 THEN 3 ELSE -5 END) || '@t>' FROM events WHERE event_id % 60 IN (7, 9, 12)), {_PLACED},
p AS (SELECT d.id, d.kind, d.parent, d.depth, d.sent_at, d.message_id, u.id AS up FROM d LEFT JOIN d u ON d.parent = u.message_id AND u.id <> d.id),
w AS (SELECT id, id AS node, [id] AS path FROM p UNION ALL SELECT w.id, p.up, list_append(w.path, p.up) FROM w JOIN p ON w.node = p.id WHERE p.up IS NOT NULL AND NOT list_contains(w.path, p.up)),
e AS (SELECT w.id, arg_max(node, len(path)) AS node, max(path) AS path FROM w GROUP BY 1),
f AS (SELECT e.id, e.path, p.up, coalesce(p.parent, p.message_id) AS top FROM e JOIN p ON e.node = p.id),
c AS (SELECT f.id, arg_min(p.message_id, (p.sent_at IS NULL, p.sent_at, p.id)) AS top FROM (SELECT id, unnest(list_slice(path, list_position(path, up), len(path))) AS node FROM f WHERE up IS NOT NULL) f JOIN p ON f.node = p.id GROUP BY 1)
SELECT p.id, p.kind, p.parent, coalesce(c.top, f.top) AS root_id, CAST(p.depth AS INTEGER) AS depth FROM p JOIN f ON p.id = f.id LEFT JOIN c ON p.id = c.id""",
    "owner_inference": f"WITH {_OWNERS} SELECT * FROM owners",
    "owner_counters": f"WITH {_HEADERS} SELECT mailbox, email, name, n, first FROM named",
    "owner_summary": f"""WITH {_OWNERS} SELECT count(*) AS row_count, count(*) FILTER (owner_confidence_label = 'high') AS high_confidence_count, count(*) FILTER (owner_confidence_label = 'medium') AS medium_confidence_count, count(*) FILTER (owner_confidence_label = 'low') AS low_confidence_count,
 count(*) FILTER (inferred_identity_type = 'corporate') AS corporate_count, count(*) FILTER (inferred_identity_type = 'system') AS system_count, count(*) FILTER (inferred_identity_type = 'external_bulk') AS external_bulk_count, count(DISTINCT mailbox_owner) AS unique_mailbox_owners, count(DISTINCT inferred_primary_email) AS unique_primary_emails,
 count(DISTINCT inferred_display_name) AS unique_display_names, count(*) FILTER (inferred_identity_type = 'system') AS corporate_mailbox_candidates, count(*) FILTER (owner_vs_sender_mismatch) AS owner_sender_mismatch_count, round(avg(owner_confidence_score), 2) AS avg_owner_confidence_score FROM owners""",
    "alias_candidates": f"WITH {_ALIASES} SELECT * FROM aliases",
    "alias_link": f"WITH {_ALIASES}, won AS (SELECT * FROM aliases WHERE alias_label IN ('strong_alias', 'possible_alias') QUALIFY row_number() OVER (PARTITION BY candidate_email ORDER BY final_alias_score, mailbox_owner DESC) = 1) SELECT a.email, w.mailbox_owner AS employee_key FROM (SELECT DISTINCT candidate_email AS email FROM aliases) a LEFT JOIN won w ON w.candidate_email = a.email",
    "report_tables": f"WITH {_OWNERS} SELECT inferred_identity_type, owner_confidence_label, count(*) AS n FROM owners GROUP BY 1, 2",
    "alias_similarity": r"""WITH c AS (SELECT c_custkey, c_nationkey, lower(c_mktsegment) || (c_custkey % 7) AS a FROM customer), s AS (SELECT s_suppkey, s_nationkey, 'build' || (s_suppkey % 7) AS b FROM supplier),
j AS (SELECT c_custkey, s_suppkey, a, b, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM c JOIN s ON c_nationkey = s_nationkey),
k AS (SELECT *, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS v FROM j)
SELECT c_custkey, s_suppkey, CASE WHEN a = b THEN 1.0 ELSE round(CASE WHEN contains(a, b) OR contains(b, a) THEN greatest(v, 0.85) ELSE v END, 4) END::DOUBLE AS similarity FROM k""",
    "alias_similarity_classes": r"""WITH p AS (SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation, c_mktsegment || (c_custkey % 7) AS name FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, 'build' || (s_suppkey % 7) FROM supplier),
g AS (SELECT kind, nation, name, min(id) AS rep FROM p GROUP BY ALL),
j AS (SELECT x.rep AS id, y.rep, lower(x.name) AS a, y.name AS b, list_distinct(string_split(lower(x.name), '')) AS x, list_distinct(string_split(y.name, '')) AS y FROM g x JOIN g y ON x.nation = y.nation AND x.kind = 'customer' AND y.kind = 'supplier'),
k AS (SELECT *, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS v FROM j)
SELECT p.kind, p.id, g.rep AS representative, NULL::DOUBLE AS similarity FROM p JOIN g ON p.kind = g.kind AND p.nation IS NOT DISTINCT FROM g.nation AND p.name IS NOT DISTINCT FROM g.name
UNION ALL SELECT 'pair', id, rep, CASE WHEN a = b THEN 1.0 ELSE round(CASE WHEN contains(a, b) OR contains(b, a) THEN greatest(v, 0.85) ELSE v END, 4) END::DOUBLE FROM k""",
    "thread_resolve_stats": f"""WITH {_THREADED},
r AS (SELECT DISTINCT event_id AS id FROM events WHERE event_id % 50 = 1 AND (event_id - 1 IN (SELECT event_id FROM events) OR event_id + 1 IN (SELECT event_id FROM events))),
k AS (SELECT CASE WHEN m.id IN (SELECT id FROM r) THEN 'r' WHEN m.in_reply_to IN (SELECT message_id FROM m) THEN 'i' WHEN m.id IN (SELECT id FROM guess) THEN 'h' ELSE 's' END AS k FROM m)
SELECT count(*) AS processed, count(*) FILTER (k = 'r') AS resolved_by_references, count(*) FILTER (k = 'i') AS resolved_by_in_reply_to, count(*) FILTER (k = 'h') AS resolved_by_heuristic, count(*) FILTER (k = 's') AS self_rooted, 0 AS unresolved, count(*) FILTER (k = 's') AS heuristic_rejected FROM k""",
    "validate_messages": f"""WITH {MAIL}, f AS (SELECT *, id % 11 = 0 AS nofile, id % 3 = 0 AS ppl, id % 5 = 1 AS refs, id % 4 = 0 AS att, id % 13 = 0 AS src FROM mail)
SELECT id, array_to_string(list_filter([CASE WHEN NOT parse_ok THEN 'parse_failed' END, CASE WHEN nofile THEN 'source_file_missing' END, CASE WHEN ppl THEN 'recipient_type_invalid[1]' END, CASE WHEN ppl THEN 'recipient_empty[1]' END,
  CASE WHEN attachment_count <> CASE WHEN att THEN 1 ELSE 0 END THEN 'attachment_count_differs' END, CASE WHEN has_attachments <> att THEN 'has_attachments_differs' END, CASE WHEN att THEN 'attachment_size_negative[0]' END], lambda x: x IS NOT NULL), ',') AS errors,
 array_to_string(list_filter([CASE WHEN sender_email IS NULL THEN 'sender_missing' END, CASE WHEN sent_at IS NULL THEN 'sent_at_missing' END, CASE WHEN coalesce(body_clean, '') = '' THEN 'body_missing' END, CASE WHEN ppl THEN 'recipient_repeated[2]' END, CASE WHEN NOT ppl THEN 'no_recipients' END, CASE WHEN refs THEN 'reference_repeated[1]' END, CASE WHEN att THEN 'attachment_anonymous[0]' END,
  CASE WHEN src AND response_to_message_id IS NULL THEN 'source_without_parent' END, CASE WHEN references_depth <> CASE WHEN refs THEN 2 ELSE 0 END THEN 'depth_differs' END], lambda x: x IS NOT NULL), ',') AS warnings,
 parse_ok AND NOT nofile AND NOT ppl AND NOT att AND attachment_count = 0 AND NOT has_attachments AS is_valid FROM f""",
}


_FILES = """
f AS (SELECT doc_id, doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END AS k, text FROM documents)
"""

_REBUILT = f"""
z AS ({SQL["thread_resolve"]}),
o AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN '<' || (event_id - 1) || '@t>' END AS parent, CASE WHEN event_type = 'click' THEN 'heuristic_subject_time_participants' END AS source, CASE WHEN event_id % 2 = 0 THEN '<' || event_id || '@t>' END AS root FROM events),
n AS (SELECT id, kind, parent, CASE kind WHEN 'references' THEN kind WHEN 'in_reply_to' THEN kind WHEN 'heuristic' THEN 'heuristic_subject_time_participants' END AS source, root_id, depth FROM z),
rebuilt AS (SELECT n.id, n.parent AS response_to_message_id, n.source AS response_to_message_id_source, n.root_id AS thread_root_message_id, n.depth AS references_depth, n.kind,
  o.parent IS DISTINCT FROM n.parent OR o.source IS DISTINCT FROM n.source OR o.root IS DISTINCT FROM n.root_id OR n.depth IS DISTINCT FROM 0 AS updated FROM n JOIN o ON n.id = o.id)
"""

SQL |= {
    "dashboard_totals": "SELECT (SELECT count(*) FROM orders) AS total_messages, (SELECT count(*) FROM nation) AS total_collaborators, (SELECT count(*) FROM customer) AS total_mailboxes, (SELECT count(*) FROM lineitem) AS total_attachments",
    "collaborator_names": f"""WITH {PEOPLE}, c AS (SELECT n_name, CASE WHEN ascii(right(n_name, 1)) % 4 = 0 THEN 'Ann' || length(n_name) END AS first_name, CASE WHEN ascii(right(n_name, 1)) % 3 = 0 THEN 'O''Hann' END AS last_name FROM nation)
SELECT c.n_name AS employee_key, c.n_name AS display_name, first_name, last_name, count(DISTINCT a.email) AS email_count, coalesce(string_agg(DISTINCT a.email, ', ' ORDER BY a.email), '') AS emails FROM c LEFT JOIN addr a ON a.employee_key = c.n_name WHERE first_name IS NOT NULL OR last_name IS NOT NULL OR contains(upper(n_name), 'ANN') GROUP BY ALL""",
    "import_headers": f"""WITH {_FILES} SELECT doc_id, '<d' || k || '@t.org>' AS message_id, CASE WHEN k % 2 = 0 THEN '<p' || (k % 6) || '@t>' END AS in_reply_to, 'user' || (k % 7) || '@corp.com' AS sender_email, 'User ' || (k % 7) AS sender_display_name,
 'Re: fw: Topic ' || (k % 10) AS subject_raw, 'topic ' || (k % 10) AS subject_normalized, CASE WHEN k % 2 = 1 THEN 'multipart/mixed' ELSE 'text/plain' END AS mime_type, TIMESTAMP '2024-01-01 08:00:00' + to_minutes(k) AS sent_at,
 CASE WHEN k % 4 = 0 THEN '<r' || (k % 6) || '@t>,<d1@t.org>' ELSE '' END AS "references", 'box_' || (k % 4) AS folder_path, TRUE AS parse_ok FROM f""",
    "import_bodies": f"""WITH {_FILES} SELECT doc_id, 'Hi ' || k || chr(10) || chr(10) || '> old' || chr(10) || 'end' AS body_clean, 'Hi ' || k || ' > old end' AS snippet, '> old' AS quoted_text, TRUE AS has_plain_text_body, FALSE AS has_html_body, TRUE AS is_response, 1 AS quoted_line_count,
 CASE WHEN k % 2 = 0 THEN '<p' || (k % 6) || '@t>' END AS response_to_message_id, CASE WHEN k % 2 = 0 THEN 'in_reply_to' END AS response_to_message_id_source, CASE WHEN k % 4 = 0 THEN '<r' || (k % 6) || '@t>' WHEN k % 2 = 0 THEN '<p' || (k % 6) || '@t>' ELSE '<d' || k || '@t.org>' END AS thread_root_message_id FROM f""",
    "import_recipients": f"""WITH {_FILES} SELECT doc_id, 'a' || (k % 5) || '@x.org' AS email, 'to' AS recipient_type, NULL AS display_name, 0 AS pos FROM f UNION ALL SELECT doc_id, 'b@corp.com', 'to', 'Bee, B', 1 FROM f UNION ALL SELECT doc_id, 'a' || (k % 5) || '@x.org', 'cc', NULL, 2 FROM f WHERE k % 3 = 0""",
    "import_attachments": f"WITH {_FILES} SELECT doc_id, 'f' || (k % 3) || '.pdf' AS filename, 'application/pdf' AS mime_type, octet_length(encode(coalesce(text, ''))) AS size_bytes FROM f WHERE k % 2 = 1",
    "import_occurrences": f"WITH {_FILES} SELECT lpad(CAST(min(doc_id) AS VARCHAR), 12, '0') AS first, count(*) AS files, count(*) AS valid FROM f GROUP BY k",
    "import_stats": f"""WITH {_FILES}, g AS (SELECT DISTINCT k FROM f) SELECT (SELECT count(*) FROM f) AS occurrences, count(*) AS messages_created, (SELECT count(*) FROM f) - count(*) AS messages_existing, 0 AS invalid, 0 AS parse_errors,
 CAST(sum(CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END) AS BIGINT) AS recipients_created, CAST(sum(CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS references_created, count(*) FILTER (k % 2 = 1) AS attachments_created FROM g""",
    "attachment_candidates": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' see: plan_' || (doc_id % 3) || '.PDF, PLAN_1.pdf; notes.tar' ELSE '' END, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM documents),
n AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '(?i)\b([a-zA-Z0-9_\-() ]{1,200}\.(?:pdf|png|jpg|jpeg|gif|bmp|tif|tiff|csv|xls|xlsx|doc|docx|ppt|pptx|txt|rtf|zip|7z|tar|gz|xml|json|eml))\b', 1), lambda x: trim(x)) AS f FROM t),
e AS (SELECT doc_id, unnest(f) AS filename, generate_subscripts(f, 1) AS i FROM n),
d AS (SELECT doc_id, arg_min(filename, i) AS filename FROM e GROUP BY doc_id, lower(filename))
SELECT doc_id, filename, MAP {'pdf': 'application/pdf', 'png': 'image/png', 'jpg': 'image/jpeg', 'jpeg': 'image/jpeg', 'gif': 'image/gif', 'csv': 'text/csv', 'xls': 'application/vnd.ms-excel', 'xlsx': 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'doc': 'application/msword', 'docx': 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'ppt': 'application/vnd.ms-powerpoint', 'pptx': 'application/vnd.openxmlformats-officedocument.presentationml.presentation', 'txt': 'text/plain', 'zip': 'application/zip', 'xml': 'application/xml', 'json': 'application/json', 'eml': 'message/rfc822'}[lower(string_split(filename, '.')[-1])] AS mime_type FROM d
UNION ALL SELECT doc_id, NULL, NULL FROM n WHERE len(f) = 0 AND regexp_matches(lower(t), 'attached|attachment|pièce jointe|pièces jointes|pj|ci-joint|enclosed')""",
    "thread_rebuild": f"WITH {_REBUILT.strip()} SELECT * FROM rebuilt",
    "thread_rebuild_stats": f"WITH {_REBUILT.strip()} SELECT s.*, (SELECT count(*) FILTER (updated) FROM rebuilt) AS updated_messages FROM ({SQL['thread_resolve_stats']}) s",
}


SQL["index_boolean"] = SQL["search_boolean"]
SQL["thread_update"] = SQL["thread_resolve_fixpoint"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
