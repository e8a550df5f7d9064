"""DuckDB SQL that gives the same rows as the query of the same name."""

from __future__ import annotations

TWEETS = """
tweets AS (
  SELECT event_id AS tweet_id, 'user' || user_id AS username, ts AS created_at,
         'now  #' || event_type || ' x#y #k' || json_extract_string(props, '$.k')
           || ' # #Up! ' AS text
  FROM events)"""

TAGS = (
    TWEETS
    + """,
words AS (
  SELECT tweet_id, created_at AS ts, unnest(string_split(text, ' ')) AS tag FROM tweets),
tags AS (SELECT * FROM words WHERE starts_with(tag, '#'))"""
)

COUNTS = (
    TAGS
    + """,
counts AS (
  SELECT date_trunc('minute', ts) + to_minutes(i) AS window_end, tag, count(*) AS cnt
  FROM tags, (SELECT unnest(range(1, 11)) AS i) AS steps
  GROUP BY ALL)"""
)

RANKED = (
    COUNTS
    + """,
ranked AS (
  SELECT window_end,
         row_number() OVER (PARTITION BY window_end ORDER BY cnt DESC, tag) AS rk, tag, cnt
  FROM counts QUALIFY rk <= 10)"""
)

REPORT = r"""
  SELECT window_end,
         chr(10) || 'Top 10 hashtags:' || chr(10)
           || string_agg('(' || cnt || ',' || tag || ')' || chr(10), '' ORDER BY rk) AS report
  FROM ranked"""

FOLLOWS = """
n AS (SELECT max(user_id) + 1 AS n FROM events),
moves AS (
  SELECT 'user' || (o_custkey % n) AS follower,
         'user' || (((o_orderkey * 7 + 3) % 23 + o_custkey % n) % n) AS followee,
         CASE WHEN o_orderstatus = 'P' THEN 'unfollow' ELSE 'follow' END AS action,
         o_orderdate AS ts, o_orderkey AS seq, o_orderpriority AS priority
  FROM orders, n)"""


def fold(source: str, name: str) -> str:
    return f"""
{name}_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY follower, followee ORDER BY ts, seq) AS i
  FROM {source}),
{name}_kept AS (
  SELECT *, coalesce(max(i) FILTER (action = 'unfollow')
                     OVER (PARTITION BY follower, followee), 0) AS gone
  FROM {name}_numbered),
{name} AS (
  SELECT follower, followee, arg_min(ts, i) AS since_ts, arg_min(seq, i) AS since_seq
  FROM {name}_kept WHERE action = 'follow' AND i > gone GROUP BY ALL)"""


EDGES = FOLLOWS + "," + fold("moves", "edges")


def positions(side: str) -> str:
    owner, member = ("follower", "followee") if side == "following" else ("followee", "follower")
    return f"""
placed AS (
  SELECT {owner} AS username, {member} AS member,
         row_number() OVER (PARTITION BY {owner} ORDER BY since_ts, since_seq) - 1 AS position
  FROM edges)"""


def lists(side: str, page_size: int) -> str:
    return f"""WITH {EDGES},{positions(side)}
  SELECT username, position // {page_size} AS page, count(*) AS n,
         string_agg(member, ',' ORDER BY position) AS members
  FROM placed GROUP BY ALL"""


USERS = """
users AS (
  SELECT 'user' || c_custkey AS username, c_name AS name FROM customer
  WHERE c_custkey IN (SELECT user_id FROM events))"""

SALT = "substr(md5(username), 1, 10)"
LOADED = "November 23rd 2014, 2:05:09 pm"
ACCOUNTS = (
    USERS
    + f""",
accounts AS (
  SELECT username, name, {SALT} || md5(username || {SALT}) AS pass, '{LOADED}' AS date
  FROM users)"""
)

DISPLAY = "strftime(created_at, '%a %b %d %Y %H:%M:%S GMT+0000')"

NEWEST = """
newest AS (
  SELECT *, row_number() OVER (
    PARTITION BY username ORDER BY created_at DESC, tweet_id DESC) AS rk
  FROM tweets QUALIFY rk <= 10)"""

HOME = f"""WITH {TWEETS},{EDGES}
  SELECT follower AS viewer, username, tweet_id, created_at, text, {DISPLAY} AS display_time,
         row_number() OVER (
           PARTITION BY follower ORDER BY created_at DESC, tweet_id DESC) AS rk
  FROM edges JOIN tweets ON followee = username QUALIFY rk <= 10"""

STAMP_TIME = "o_orderdate + to_seconds(o_orderkey % 86400)"

LINE_TIME = """
CASE event_type
  WHEN 'error' THEN NULL
  WHEN 'view' THEN date_trunc('second', ts)
  ELSE date_trunc('millisecond', ts) END"""


def user_line(name: str) -> str:
    return f"""'{{"username":"user' || c_custkey || '","name":"' || {name} || '"'
      || CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE
           ',"followers":["user' || (c_custkey + 2) || '"],"following":["user'
           || (c_custkey + 1) || '","user' || (c_custkey + 3) || '","user'
           || (c_custkey + 1) || '"]' END || '}}'"""


SIGN_UPS = """
requests AS (
  SELECT event_id AS request_id, 'user' || user_id AS username, 'Name ' || event_type AS name,
         user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
           OR event_id > min(event_id) OVER (PARTITION BY user_id) AS taken
  FROM events)"""

LIST_UPDATES = f"""WITH {EDGES},{positions('following')}
  SELECT username,
         string_agg(member, ',' ORDER BY position)
           || CASE WHEN bool_or(member = 'user7') THEN '' ELSE ',user7' END AS followed,
         coalesce(string_agg(member, ',' ORDER BY position) FILTER (member <> 'user7'), '')
           AS unfollowed
  FROM placed GROUP BY username"""

LOADED_TWEETS = f"""WITH {TWEETS},
  times AS (SELECT event_id AS tweet_id, {LINE_TIME} AS parsed FROM events)
  SELECT parsed AS created_at, text, username, NULL::VARCHAR AS name
  FROM tweets JOIN times USING (tweet_id) WHERE parsed IS NOT NULL"""

POSTED = f"""WITH {TWEETS},{USERS}
  SELECT created_at, text, username, name FROM tweets LEFT JOIN users USING (username)"""


def kept_expired(slide: int, steps: int) -> str:
    """Trending with tags of count 0, for a slide in seconds and a window of so many slides."""
    start = f"time_bucket(to_seconds({slide}), {{}}, TIMESTAMP '1970-01-01')"
    return f"""WITH {TAGS},
  counts AS (
    SELECT {start.format("ts")} + to_seconds({slide} * i) AS window_end, tag, count(*) AS cnt
    FROM tags, (SELECT unnest(range(1, {steps + 1})) AS i) AS steps GROUP BY ALL),
  seen AS (
    SELECT tag, {start.format("min(ts)")} + to_seconds({slide}) AS first FROM tags GROUP BY tag),
  grid AS (
    SELECT unnest(generate_series(min(window_end), max(window_end), to_seconds({slide})))
      AS window_end FROM counts),
  states AS (
    SELECT grid.window_end, seen.tag, coalesce(cnt, 0) AS cnt
    FROM grid JOIN seen ON seen.first <= grid.window_end
    LEFT JOIN counts ON counts.window_end = grid.window_end AND counts.tag = seen.tag)
  SELECT window_end,
         row_number() OVER (PARTITION BY window_end ORDER BY cnt DESC, tag) AS rk, tag, cnt
  FROM states QUALIFY rk <= 10"""


ORACLES: dict[str, str] = {
    "hashtag_tokens": f"""WITH {TWEETS},
  lists AS (SELECT tweet_id, string_split(text, ' ') AS l FROM tweets),
  placed AS (SELECT tweet_id, unnest(range(len(l))) AS pos, unnest(l) AS tag FROM lists)
  SELECT * FROM placed WHERE starts_with(tag, '#')""",
    "hashtag_totals": f"WITH {TAGS} SELECT tag, count(*) AS cnt FROM tags GROUP BY tag",
    "hashtag_global_top10": f"""WITH {TAGS}
  SELECT tag, count(*) AS cnt FROM tags GROUP BY tag ORDER BY cnt DESC, tag LIMIT 10""",
    "hashtag_window_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "hashtag_window_counts_chained": f"WITH {COUNTS} SELECT * FROM counts",
    "hashtag_window_counts_delta": f"WITH {COUNTS} SELECT * FROM counts",
    "trending_top10": f"WITH {RANKED} SELECT * FROM ranked",
    "trending_expand": f"WITH {RANKED} SELECT * FROM ranked",
    "trending_keep_expired": f"""WITH {COUNTS},
  seen AS (SELECT tag, date_trunc('minute', min(ts)) + to_minutes(1) AS first FROM tags GROUP BY tag),
  grid AS (
    SELECT unnest(generate_series(min(window_end), max(window_end), to_minutes(1)))
      AS window_end FROM counts),
  states AS (
    SELECT grid.window_end, seen.tag, coalesce(cnt, 0) AS cnt
    FROM grid JOIN seen ON seen.first <= grid.window_end
    LEFT JOIN counts ON counts.window_end = grid.window_end AND counts.tag = seen.tag)
  SELECT window_end,
         row_number() OVER (PARTITION BY window_end ORDER BY cnt DESC, tag) AS rk, tag, cnt
  FROM states QUALIFY rk <= 10""",
    "trending_keep_expired_7min": kept_expired(420, 10),
    "trending_keep_expired_36h": kept_expired(129600, 2),
    "trending_uneven": f"""WITH {TAGS},
  ends AS (
    SELECT ts, tag, date_trunc('minute', ts) + to_minutes(i) AS window_end
    FROM tags, (SELECT unnest(range(1, 4)) AS i) AS steps),
  counts AS (
    SELECT window_end, tag, count(*) AS cnt FROM ends
    WHERE window_end - to_seconds(150) <= ts GROUP BY ALL)
  SELECT window_end,
         row_number() OVER (PARTITION BY window_end ORDER BY cnt DESC, tag) AS rk, tag, cnt
  FROM counts QUALIFY rk <= 10""",
    "trending_report_text": f"WITH {RANKED} {REPORT} GROUP BY window_end",
    "follow_edges": f"WITH {EDGES} SELECT * FROM edges",
    "follow_edges_incremental": f"WITH {EDGES} SELECT * FROM edges",
    "following_lists": lists("following", 10_000),
    "followers_lists": lists("followers", 10_000),
    "followers_lists_paged": lists("followers", 4),
    "following_positions": f"WITH {EDGES},{positions('following')} SELECT * FROM placed",
    "is_following": f"""WITH {EDGES},
  requests AS (
    SELECT event_id AS request_id, 'user' || user_id AS viewer,
           'user' || ((user_id + CAST(json_extract_string(props, '$.k') AS BIGINT)) % n) AS profile
    FROM events, n)
  SELECT requests.*, follower IS NOT NULL AS following
  FROM requests LEFT JOIN edges ON follower = viewer AND followee = profile""",
    "lists_contain": f"""WITH {EDGES}
  SELECT follower AS username, bool_or(followee = 'user7') AS following_them
  FROM edges GROUP BY follower""",
    "lists_contain_paged": f"""WITH {EDGES}
  SELECT follower AS username, bool_or(followee = 'user7') AS following_them
  FROM edges GROUP BY follower""",
    "list_updates": LIST_UPDATES,
    "list_updates_paged": LIST_UPDATES,
    "list_updates_one_page": LIST_UPDATES,
    "stored_followers_lists": """SELECT 'user' || c_custkey AS username, 0::BIGINT AS page,
    1::BIGINT AS n, 'user' || (c_custkey + 2) AS members
  FROM customer WHERE c_mktsegment <> 'FURNITURE'""",
    "follow_asymmetry": f"""WITH {EDGES},
  arrived AS (SELECT * FROM moves WHERE priority <> '5-LOW'),{fold("arrived", "others")}
  SELECT coalesce(e.follower, o.follower) AS follower, coalesce(e.followee, o.followee) AS followee,
         CASE WHEN o.follower IS NULL THEN 'following' ELSE 'followers' END AS only_in
  FROM edges e FULL JOIN others o ON e.follower = o.follower AND e.followee = o.followee
  WHERE e.follower IS NULL OR o.follower IS NULL""",
    "follow_unknown_users": f"""WITH {USERS}
  SELECT 'user' || o_custkey AS follower, 'user' || (o_orderkey % 1000) AS followee,
         o_orderdate AS ts, o_orderkey AS seq,
         'user' || o_custkey IN (SELECT username FROM users) AS follower_known,
         'user' || (o_orderkey % 1000) IN (SELECT username FROM users) AS followee_known
  FROM orders""",
    "tweets_with_names": f"""WITH {TWEETS},{USERS}
  SELECT tweets.*, name FROM tweets LEFT JOIN users USING (username)""",
    "tweets_with_names_bucketed": f"""WITH {TWEETS},{USERS}
  SELECT tweets.*, name FROM tweets LEFT JOIN users USING (username)""",
    "profile_timeline": f"""WITH {TWEETS},{USERS},{NEWEST}
  SELECT newest.*, name, {DISPLAY} AS display_time, name || '''s Profile:' AS title
  FROM newest LEFT JOIN users USING (username)""",
    "profile_timeline_one": f"""WITH {TWEETS}
  SELECT *, {DISPLAY} AS display_time FROM tweets WHERE username = 'user7'
  ORDER BY created_at DESC, tweet_id DESC LIMIT 10""",
    "home_timeline": HOME,
    "home_timeline_salted": HOME,
    "home_timeline_shared_ids": f"""WITH {TWEETS.replace("tweets AS", "numbered AS", 1)},
tweets AS (
  SELECT row_number() OVER (PARTITION BY username ORDER BY tweet_id) AS tweet_id, username,
         created_at, text FROM numbered),{EDGES}
  SELECT follower AS viewer, username, tweet_id, created_at, text, {DISPLAY} AS display_time,
         row_number() OVER (
           PARTITION BY follower ORDER BY created_at DESC, tweet_id DESC, username) AS rk
  FROM edges JOIN tweets ON followee = username QUALIFY rk <= 10""",
    "home_timeline_one": f"""WITH {TWEETS},{EDGES}
  SELECT *, {DISPLAY} AS display_time FROM tweets
  WHERE username IN (SELECT followee FROM edges WHERE follower = 'user7')
  ORDER BY created_at DESC, tweet_id DESC LIMIT 10""",
    "followee_tweets": f"""WITH {TWEETS},{EDGES}
  SELECT * FROM tweets
  WHERE username IN (SELECT followee FROM edges WHERE follower = 'user7')""",
    "home_titles": f"WITH {USERS} SELECT username, name || '''s Timeline:' AS title FROM users",
    "find_one_user": f"WITH {USERS} SELECT * FROM users WHERE username = 'user7' LIMIT 1",
    "lookup_by_index": f"WITH {TWEETS} SELECT tweet_id, username, created_at FROM tweets WHERE username = 'user7'",
    "find_many_users": f"""WITH {USERS},{FOLLOWS}
  SELECT * FROM users WHERE username IN (SELECT followee FROM moves)""",
    "display_times": f"WITH {TWEETS} SELECT tweet_id, {DISPLAY} AS display_time FROM tweets",
    "account_stamps": f"""WITH t AS (SELECT o_orderkey, {STAMP_TIME} AS t_at FROM orders)
  SELECT o_orderkey,
         strftime(t_at, '%B ') || day(t_at)
           || CASE WHEN day(t_at) IN (11, 12, 13) THEN 'th' WHEN day(t_at) % 10 = 1 THEN 'st'
                   WHEN day(t_at) % 10 = 2 THEN 'nd' WHEN day(t_at) % 10 = 3 THEN 'rd' ELSE 'th' END
           || strftime(t_at, ' %Y, %-I:%M:%S ') || lower(strftime(t_at, '%p')) AS stamp
  FROM t""",
    "parsed_dates": f"SELECT event_id AS tweet_id, {LINE_TIME} AS created_at FROM events",
    "parsed_date_forms": """SELECT event_id AS tweet_id,
    CASE WHEN event_id % 12 IN (6, 7, 8) THEN NULL
         WHEN event_id % 12 IN (9, 10) THEN date_trunc('day', ts)
         WHEN event_id % 12 IN (0, 2) THEN date_trunc('millisecond', ts)
         ELSE date_trunc('second', ts) END AS created_at
  FROM events""",
    "users_dedup": f"""WITH {TWEETS}
  SELECT username, created_at, tweet_id FROM tweets
  QUALIFY row_number() OVER (PARTITION BY username ORDER BY created_at, tweet_id) = 1""",
    "users_not_taken": """SELECT 'user' || c_custkey AS username, c_name AS name FROM customer
  WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "sign_up_outcomes": f"""WITH {SIGN_UPS}
  SELECT request_id, username, name,
         CASE WHEN taken THEN 'username-taken' ELSE 'created' END AS outcome FROM requests""",
    "new_accounts": f"""WITH {SIGN_UPS}
  SELECT username, name, {SALT} || md5(username || {SALT}) AS pass, '{LOADED}' AS date
  FROM requests WHERE NOT taken""",
    "account_credentials": f"WITH {ACCOUNTS} SELECT * FROM accounts",
    "credential_outcomes": f"""WITH {ACCOUNTS},
  n AS (SELECT max(user_id) + 1 AS n FROM events),
  attempts AS (
    SELECT o_orderkey AS attempt_id, 'user' || (o_custkey % (2 * n)) AS username,
           CASE WHEN o_orderstatus = 'F' THEN 'user' || (o_custkey % (2 * n))
                ELSE o_orderpriority END AS password
    FROM orders, n)
  SELECT attempts.*,
         CASE WHEN pass IS NULL THEN 'user-not-found'
              WHEN substr(pass, 1, 10) || md5(password || substr(pass, 1, 10)) = pass THEN 'ok'
              ELSE 'invalid-password' END AS outcome
  FROM attempts LEFT JOIN accounts USING (username)""",
    "default_passwords": f"""WITH {USERS}
  SELECT username FROM users WHERE length(username) % 2 = 0""",
    "topic_messages": f"""WITH {TAGS} SELECT tag, count(*) AS cnt FROM tags GROUP BY tag""",
    "topic_message_posts": f"WITH {RANKED} SELECT * FROM ranked",
    "posts_without_times": "SELECT event_id AS tweet_id, event_type = 'error' AS stamped_now FROM events",
    "stream_trending_clock": f"WITH {RANKED} SELECT * FROM ranked",
    "tweet_length_rejects": """SELECT doc_id,
    CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) > 140 THEN 'too_long' END
      AS problem FROM documents""",
    "new_tweet_records": f"""WITH {TWEETS},{USERS}
  SELECT tweet_id, created_at, text, username, name
  FROM tweets LEFT JOIN users USING (username)""",
    "bulk_load_users": f"""WITH users AS (
    SELECT 'user' || c_custkey AS username, c_name AS name FROM customer)
  SELECT username, name, {SALT} || md5(username || {SALT}) AS pass, '{LOADED}' AS date
  FROM users""",
    "bulk_load_following_edges": """WITH places AS (
    SELECT c_custkey, unnest([0, 1]) AS pos FROM customer WHERE c_mktsegment <> 'FURNITURE')
  SELECT 'user' || c_custkey AS follower, 'user' || (c_custkey + 1 + 2 * pos) AS followee,
         TIMESTAMP '2014-11-23 14:05:09' AS since_ts, pos::BIGINT AS since_seq FROM places""",
    "bulk_load_followers": """SELECT 'user' || c_custkey AS username,
    CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'user' || (c_custkey + 2) END AS followers
  FROM customer""",
    "bulk_load_tweets": LOADED_TWEETS,
    "ingest_after_load": f"""SELECT * FROM ({LOADED_TWEETS})
  UNION ALL SELECT * FROM ({POSTED}) UNION ALL SELECT * FROM ({POSTED})""",
    "bulk_load_rejects": f"""WITH {TWEETS}
  SELECT 'users' AS input, 'malformed' AS reason, '{{bad ' || c_name AS line
  FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL
  SELECT 'users', 'duplicate_username', {user_line("'Other ' || c_name")}
  FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL
  SELECT 'tweets', 'bad_created_at',
         '{{"created_at":"nope","text":"' || text || '","username":"' || username || '"}}'
  FROM tweets JOIN events ON event_id = tweet_id WHERE event_type = 'error'""",
    "stream_trending": f"WITH {RANKED} SELECT * FROM ranked",
    "stream_trending_reports": f"WITH {RANKED} {REPORT} GROUP BY window_end",
    "stream_sign_ups": f"""WITH {SIGN_UPS}
  SELECT request_id, username, name,
         CASE WHEN taken THEN 'username-taken' ELSE 'created' END AS outcome FROM requests""",
    "restarted_stream_state": f"""WITH {TAGS},
  runs(run, until) AS (VALUES (1, TIMESTAMP '2024-01-16'), (2, TIMESTAMP '9999-01-01')),
  newest AS (SELECT run, max(ts) AS newest FROM events JOIN runs ON ts < until GROUP BY run),
  slots AS (
    SELECT run, newest, date_trunc('minute', ts) + to_minutes(1) AS slot_end, tag, count(*) AS cnt
    FROM tags JOIN runs ON ts < until JOIN newest USING (run) GROUP BY ALL),
  windows AS (
    SELECT run, newest, slot_end + to_minutes(i) AS window_end, tag, sum(cnt)::BIGINT AS cnt
    FROM slots, (SELECT unnest(range(0, 10)) AS i) AS steps WHERE slot_end <= newest GROUP BY ALL)
  SELECT run, 'slot' AS level, slot_end AS "end", tag, cnt FROM slots WHERE slot_end > newest
  UNION ALL
  SELECT run, 'window', window_end, tag, cnt FROM windows WHERE window_end > newest""",
    "stream_late_rows": f"""WITH {TAGS},
  newest AS (SELECT max(ts) - INTERVAL 6 HOUR AS done FROM events WHERE event_id % 3 <> 0),
  late AS (
    SELECT DISTINCT date_trunc('minute', ts) + to_minutes(1) AS slot_end, tag
    FROM tags WHERE tweet_id % 3 = 0)
  SELECT (SELECT count(*) FROM events) AS rows,
         (SELECT count(*) FROM late, newest WHERE slot_end <= done) AS dropped""",
    "stream_follow_state": f"WITH {EDGES} SELECT follower, followee FROM edges",
    "follow_state_compacted": f"WITH {EDGES} SELECT follower, followee, since_ts, since_seq FROM edges",
    "streamed_following_lists": lists("following", 10_000),
    "long_loaded_list": f"""WITH {EDGES},
  everybody AS (
    SELECT 'user0' AS follower, 'user' || c_custkey AS followee, TIMESTAMP '2014-11-23 14:05:09' AS since_ts,
           c_custkey * 7 % 1000 AS since_seq FROM customer
    UNION ALL SELECT follower, followee, since_ts, since_seq FROM edges WHERE follower <> 'user0')
  SELECT follower AS username, followee AS member,
         row_number() OVER (PARTITION BY follower ORDER BY since_ts, since_seq, followee) - 1 AS position
  FROM everybody""",
    "load_twice": """SELECT 'user' AS kind, 'user' || c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL
  SELECT 'tweet', 'user' || user_id FROM events WHERE event_id % 100 = 0 AND event_type <> 'error'""",
    "stream_post_ingest": f"""WITH {TWEETS},{USERS}
  SELECT tweet_id, created_at, text, username, name
  FROM tweets LEFT JOIN users USING (username)""",
    "stream_relayed_topic": f"""WITH {TWEETS}
  SELECT text AS value, count(*) AS n FROM tweets GROUP BY text""",
    "stream_post_topic": f"""WITH {TWEETS}
  SELECT text AS value, count(*) AS n FROM tweets GROUP BY text""",
}
