"""DuckDB twins of the registered queries.

Written against the test tables alone, in the plainest SQL for the meaning:
no statement is derived from the Spark plan it is compared with.
"""

from __future__ import annotations

import re

# Derived tables, each in terms of test tables and those before it.
_CTES = {
    "assets": """
        SELECT p_partkey AS asset_id, p_brand AS brand, p_type AS series_name,
               p_name AS episode_name, CAST(p_size AS VARCHAR) AS episode_number,
               CAST(p_partkey % 8 + 1 AS VARCHAR) AS season_number,
               CASE WHEN p_size <= 25 THEN 'Series' ELSE 'Movie' END AS program_type,
               CASE p_partkey % 3 WHEN 0 THEN 'TV-G' WHEN 1 THEN 'TV-14' END AS rating,
               '1995-01-01' AS available_date, '2002-12-31' AS expiration_date
        FROM part""",
    "viewing": """
        SELECT CAST(l_shipdate AS DATE) AS event_date, l_partkey AS asset_id,
               CASE l_returnflag WHEN 'A' THEN 'Web' WHEN 'N' THEN 'Mobile'
                    ELSE 'Connected' END AS platform,
               p_brand AS brand,
               CASE l_linestatus WHEN 'O' THEN 'OnDemand' ELSE 'Live' END AS content_type,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'IntroTV' WHEN '2-HIGH' THEN '' END
                    AS x1_user_type,
               CASE WHEN l_partkey % 5 <> 0 THEN 'EP' || l_partkey END AS gracenote_id,
               CAST(o_custkey AS VARCHAR) AS device_id,
               '199' || (l_partkey % 10) || '-01-01' AS air_date,
               CAST(l_quantity * 100 AS BIGINT) AS duration_secs,
               CAST(l_quantity * 16 * l_linenumber AS BIGINT) AS viewed_secs
        FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey
        JOIN part ON p_partkey = l_partkey""",
    "plays": """
        SELECT *, CASE WHEN duration_secs <> 0
                       THEN 100.0 * viewed_secs / duration_secs END AS pct
        FROM viewing""",
    **{
        f"summary_{grain}": f"""
        SELECT {day} AS event_date, asset_id, platform, brand, content_type,
               x1_user_type, gracenote_id,
               max(coalesce(duration_secs, 0)) AS total_duration, air_date,
               count(*) AS content_starts,
               count(*) FILTER (pct > 25) AS pct25_viewed,
               count(*) FILTER (pct > 50) AS pct50_viewed,
               count(*) FILTER (pct > 75) AS pct75_viewed,
               count(*) FILTER (pct > 95) AS pct95_viewed,
               count(*) FILTER (pct >= 100) AS pct100_viewed,
               CAST(sum(coalesce(viewed_secs, 0)) AS BIGINT) AS total_seconds_viewed,
               count(DISTINCT device_id) AS unique_devices
        FROM plays
        GROUP BY {day}, asset_id, platform, brand, content_type, x1_user_type,
                 gracenote_id, air_date"""
        for grain, day in (
            ("daily", "event_date"),
            ("weekly", "CAST(date_trunc('week', event_date) AS DATE)"),
            ("monthly", "CAST(date_trunc('month', event_date) AS DATE)"),
        )
    },
    "raw_events": """
        SELECT event_id, epoch_us(ts) // 1000 AS event_timestamp,
               CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS event_datekey,
               CASE event_type WHEN 'click' THEN 'ios' WHEN 'view' THEN 'android'
                    WHEN 'purchase' THEN 'chromecast' WHEN 'error' THEN 'firetv'
                    ELSE 'web' END AS platform,
               CASE WHEN event_id % 2 = 0 THEN 'Live' ELSE 'On-Demand' END AS entity_type,
               json_extract_string(props, '$.k') AS program_id,
               json_extract_string(props, '$.k') AS media_guid,
               CAST(user_id AS VARCHAR) AS device_id,
               CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN ''
                    ELSE 'Brand#' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 + 1)
                    END AS company,
               'Prov#' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS provider,
               CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Ser' END AS series_name,
               CAST(NULL AS VARCHAR) AS season_number, '1' AS episode_number,
               'Ep' AS episode_name, '2024-01-01' AS airdate,
               CAST(CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0
                    ELSE 400 END AS BIGINT) AS duration_secs,
               CAST(floor(value) AS BIGINT) AS viewed_secs,
               CASE WHEN user_id % 5 = 0 THEN 'introtv' END AS x1_user_type
        FROM events""",
    "event_assets": """
        SELECT CAST(p_partkey AS VARCHAR) AS asset_key,
               CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'EP' || p_partkey END AS tms_episode_id,
               CASE WHEN p_partkey % 11 <> 0 THEN '2024-01-01' END AS last_update
        FROM part""",
    "live_filtered_devices": """
        SELECT device_id, program_id, CAST(device_id AS BIGINT) % 2 = 0 AS time_diff,
               4 * (count(*) - 1) AS program_count
        FROM raw_events WHERE entity_type = 'Live' GROUP BY device_id, program_id""",
    "excluded": """
        SELECT DISTINCT device_id, program_id FROM live_filtered_devices
        WHERE time_diff = true AND program_count > 3""",
    "dated_events": """
        SELECT *, CAST(epoch_ms(event_timestamp) AT TIME ZONE 'UTC'
                       AT TIME ZONE 'EST5EDT' AS DATE) AS event_day,
               CASE WHEN duration_secs <> 0
                    THEN 100.0 * viewed_secs / duration_secs END AS pct,
               CASE platform WHEN 'ios' THEN 'Mobile' WHEN 'android' THEN 'Mobile'
                    WHEN 'chromecast' THEN 'Connected' WHEN 'firetv' THEN 'Connected'
                    ELSE 'Web' END AS bucket
        FROM raw_events""",
    "recent_events": """
        SELECT * FROM dated_events
        WHERE date_diff('day', event_day, DATE '2024-01-15') BETWEEN 0 AND 7
          AND event_datekey BETWEEN 20240101 AND 20240116""",
    "events_of_two_runs": """
        SELECT * FROM dated_events
        WHERE date_diff('day', event_day, DATE '2024-01-12') BETWEEN 0 AND 7
          AND event_datekey BETWEEN 20231229 AND 20240113
          AND (event_datekey < 20240113 OR event_id % 4 < 2)
           OR date_diff('day', event_day, DATE '2024-01-15') BETWEEN 0 AND 7
          AND event_datekey BETWEEN 20240101 AND 20240116""",
    **{
        f"merged_{name}": f"""
        SELECT DISTINCT '{content_type}' AS content_type, event_day AS eventdate,
               event_datekey, bucket AS platform,
               coalesce(nullif({brand}, ''), 'N/A') AS brand,
               coalesce(nullif(series_name, ''), 'N/A') AS series_title,
               coalesce(nullif(season_number, ''), 'N/A') AS season_number,
               coalesce(nullif(episode_number, ''), 'N/A') AS episode_number,
               coalesce(nullif(episode_name, ''), 'N/A') AS episode_name,
               coalesce(nullif(tms_episode_id, ''), 'N/A') AS gracenote_id,
               airdate, event_id, e.device_id AS device_id,
               coalesce(duration_secs, 0) AS duration_secs,
               coalesce(viewed_secs, 0) AS viewed_secs,
               CASE WHEN pct > 25 THEN 1 ELSE 0 END AS pct25_viewed,
               CASE WHEN pct > 50 THEN 1 ELSE 0 END AS pct50_viewed,
               CASE WHEN pct > 75 THEN 1 ELSE 0 END AS pct75_viewed,
               CASE WHEN pct > 95 THEN 1 ELSE 0 END AS pct95_viewed,
               CASE WHEN pct >= 100 THEN 1 ELSE 0 END AS pct100_viewed,
               x1_user_type
        FROM recent_events e
        JOIN event_assets a ON a.asset_key = e.{key}
        {exclude}
        WHERE e.entity_type = '{entity}' AND a.last_update IS NOT NULL {keep}"""
        for name, content_type, entity, key, brand, exclude, keep in (
            ("live", "Live", "Live", "program_id", "company",
             "LEFT JOIN excluded x ON x.device_id = e.device_id"
             " AND x.program_id = e.program_id",
             "AND x.device_id IS NULL"),
            ("ondemand", "OnDemand", "On-Demand", "media_guid", "provider", "", ""),
        )
    },
    "merged_events": "SELECT * FROM merged_live UNION ALL SELECT * FROM merged_ondemand",
    "users": """
        SELECT c_custkey AS user_id, c_name AS name,
               'u' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS email,
               CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal >= 0 END AS is_active,
               CASE WHEN c_custkey % 4 <> 0 THEN 'secret' END AS password
        FROM customer""",
    "groups_": """
        SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS name,
               CASE WHEN n_nationkey % 2 = 0 THEN 'Live' ELSE 'OnDemand' END AS content_type
        FROM nation""",
    "brands": """
        SELECT s_suppkey AS brand_id, 'Brand ' || (s_suppkey % 40) AS name,
               CASE WHEN s_suppkey % 2 = 0 THEN 'Live' ELSE 'OnDemand' END AS content_type
        FROM supplier""",
    "users_groups": """
        SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS group_id
        FROM customer WHERE c_custkey % 10 <> 9
        UNION ALL
        SELECT c_custkey, CAST((c_nationkey + 7) % 25 AS BIGINT)
        FROM customer WHERE c_custkey % 3 = 0""",
    "groups_brands": """
        SELECT CAST(s_nationkey AS BIGINT) AS group_id, s_suppkey AS brand_id
        FROM supplier WHERE s_nationkey % 6 <> 0""",
    "users_brands": """
        SELECT DISTINCT o_custkey AS user_id, l_suppkey AS brand_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "roles": """
        SELECT row_number() OVER (ORDER BY name) AS role_id, name,
               upper(name[1]) || lower(name[2:]) AS label
        FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)""",
    "users_roles": """
        SELECT c_custkey AS user_id, role_id FROM customer JOIN roles ON name = c_mktsegment""",
    "providers": """
        SELECT CAST(r_regionkey AS BIGINT) AS provider_id, r_name AS name FROM region""",
    "providers_brands": """
        SELECT CAST(n_regionkey AS BIGINT) AS provider_id, s_suppkey AS brand_id
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "brands_brands": """
        SELECT DISTINCT s_suppkey AS brand_id, other AS linked_brand_id
        FROM (SELECT s_suppkey, unnest([s_suppkey // 2, s_suppkey // 3]) AS other
              FROM supplier WHERE s_suppkey % 4 <> 3)
        WHERE other <> s_suppkey""",
    "legacy_users": """
        SELECT c_custkey + 100000 AS id, c_name AS name,
               'u' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS email,
               c_acctbal >= 0 AS is_active
        FROM customer WHERE c_custkey % 4 <> 0""",
    "legacy_users_brands": """
        SELECT user_id + 100000 AS user_id, brand_id FROM users_brands WHERE brand_id % 3 <> 0""",
    "legacy_users_roles": """
        SELECT user_id + 100000 AS user_id, role_id FROM users_roles WHERE user_id % 6 <> 0""",
    "legacy_groups": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
               'Region ' || n_regionkey AS description
        FROM nation""",
    "legacy_users_groups": """
        SELECT user_id + 100000 AS user_id, group_id FROM users_groups""",
    "desired": """
        SELECT user_id, brand_id FROM users_brands WHERE (user_id + brand_id) % 7 <> 0
        UNION
        SELECT c_custkey, c_custkey % 100 FROM customer WHERE c_custkey % 50 = 0""",
    "removed": "SELECT * FROM users_brands EXCEPT SELECT * FROM desired",
    "added": "SELECT * FROM desired EXCEPT SELECT * FROM users_brands",
    # Every copy of a removed brand, for the user it was removed from.
    "expanded": """
        SELECT DISTINCT r.user_id, b2.brand_id
        FROM removed r JOIN brands b1 ON b1.brand_id = r.brand_id
        JOIN brands b2 ON b2.name = b1.name AND b2.content_type = b1.content_type""",
    "group_changes": """
        SELECT c_custkey * 7919 % 1000003 AS seq,
               CASE c_custkey % 3 WHEN 0 THEN c_custkey % 31 WHEN 1 THEN -c_custkey END AS group_id,
               CASE WHEN c_custkey % 3 = 0
                    THEN CASE WHEN c_custkey % 4 <> 0 THEN 'Renamed ' || (c_custkey % 40) END
                    WHEN c_custkey % 7 = 0 THEN '  '
                    WHEN c_custkey % 7 = 1 THEN 'Renamed ' || (c_custkey % 40)
                    WHEN c_custkey % 2 = 0 THEN ' ' || n_name || '  '
                    ELSE ' New ' || (c_custkey % 11) || ' ' END AS name,
               CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 5 = 0
                    THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Live' ELSE 'OnDemand' END END AS content_type
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    # An entry is replaced by a later one of its group.
    "renamed_groups": """
        SELECT g.group_id, coalesce(c.name, g.name) AS name,
               coalesce(c.content_type, g.content_type) AS content_type
        FROM groups_ g LEFT JOIN (
            SELECT * FROM group_changes c WHERE NOT EXISTS (
                SELECT 1 FROM group_changes later WHERE later.group_id = c.group_id AND later.seq > c.seq)
        ) c ON c.group_id = g.group_id AND c.group_id > 0""",
    "created_groups": """
        SELECT (SELECT max(group_id) FROM groups_) + row_number() OVER (ORDER BY name, content_type) AS group_id,
               name, content_type
        FROM (SELECT DISTINCT trim(name) AS name, content_type FROM group_changes
              WHERE coalesce(group_id, 0) <= 0 AND trim(name) <> '') c
        WHERE NOT EXISTS (SELECT 1 FROM renamed_groups r
                          WHERE r.name = c.name AND r.content_type = c.content_type)""",
    "stamped_users": """
        SELECT user_id, name, email, is_active, DATE '2020-01-01' AS creation_date,
               CAST(1 AS BIGINT) AS created_by_id, CAST(NULL AS DATE) AS modification_date,
               CAST(NULL AS BIGINT) AS modified_by_id
        FROM users""",
    "user_changes": """
        SELECT c_custkey * 7919 % 1000003 AS seq,
               CASE c_custkey % 4 WHEN 0 THEN c_custkey % 97 WHEN 1 THEN c_custkey + 900000000 END AS user_id,
               CASE WHEN c_custkey % 5 <> 0 THEN 'Name ' || c_custkey END AS name,
               CASE WHEN c_custkey % 8 = 0 THEN 'moved' || c_custkey || '@x.example'
                    WHEN c_custkey % 4 = 2 AND c_custkey % 6 <> 0 THEN ' n' || (c_custkey % 50) || '@x.example '
                    WHEN c_custkey % 4 = 3
                    THEN 'u' || (c_custkey // 4) || '@' || lower(c_mktsegment) || '.example' END AS email,
               c_custkey % 3 = 0 AS is_active
        FROM customer""",
    "moved_users": """
        SELECT u.user_id, coalesce(c.name, u.name) AS name, coalesce(c.email, u.email) AS email,
               coalesce(c.is_active, u.is_active) AS is_active, creation_date, created_by_id,
               CASE WHEN c.user_id > 0 THEN DATE '2024-01-16' END AS modification_date,
               CASE WHEN c.user_id > 0 THEN 42 END AS modified_by_id
        FROM stamped_users u LEFT JOIN (
            SELECT * FROM user_changes c WHERE NOT EXISTS (
                SELECT 1 FROM user_changes later WHERE later.user_id = c.user_id AND later.seq > c.seq)
        ) c ON c.user_id = u.user_id AND c.user_id > 0""",
    "asked_users": """
        SELECT trim(email) AS asked, arg_max(row(name, is_active), seq) AS v FROM user_changes
        WHERE coalesce(user_id, 0) <= 0 AND trim(email) <> '' GROUP BY trim(email)""",
    "typed_brands": """
        SELECT brand_id, name, CASE WHEN brand_id % 10 = 5 THEN 'Radio' ELSE content_type END AS content_type
        FROM brands""",
    # Copies that go with a link to a brand of an edited type.
    "typed_expanded": """
        SELECT DISTINCT r.user_id, b2.brand_id
        FROM removed r JOIN typed_brands b1 ON b1.brand_id = r.brand_id AND b1.content_type <> 'Radio'
        JOIN typed_brands b2 ON b2.name = b1.name AND b2.content_type = b1.content_type""",
    "edited": """
        SELECT c_custkey AS user_id, 'OnDemand' AS content_type FROM customer
        WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 1
        UNION ALL
        SELECT c_custkey, 'Live' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""",
    "listed": """
        SELECT e.user_id, b.brand_id
        FROM edited e JOIN users_brands ub USING (user_id)
        JOIN typed_brands b ON b.brand_id = ub.brand_id AND b.content_type = e.content_type
        WHERE (ub.user_id + ub.brand_id) % 5 <> 0 AND NOT (e.content_type = 'OnDemand' AND e.user_id % 4 = 0)
        UNION
        SELECT e.user_id, b.brand_id
        FROM edited e JOIN typed_brands b ON b.content_type = e.content_type
             AND b.brand_id IN (e.user_id % 90 + 1, e.user_id % 17)
        WHERE e.content_type = 'OnDemand' AND e.user_id % 4 <> 0""",
    "unlisted": """
        SELECT DISTINCT ub.user_id, b2.brand_id
        FROM users_brands ub JOIN typed_brands b1 USING (brand_id)
        JOIN edited e ON e.user_id = ub.user_id AND e.content_type = b1.content_type
        JOIN typed_brands b2 ON b2.name = b1.name AND b2.content_type = b1.content_type
        WHERE (ub.user_id, ub.brand_id) NOT IN (SELECT (user_id, brand_id) FROM listed)""",
    "numbered_names": r"""
        SELECT *, regexp_replace(digits, '^0+', '') AS plain FROM (
            SELECT c_custkey AS user_id,
                   CASE c_custkey % 6
                        WHEN 0 THEN 'Brand ' || (c_custkey % 40)
                        WHEN 1 THEN ' bRAND' || chr(9) || '00' || (c_custkey % 40) || 'b' || (c_custkey % 7)
                        WHEN 2 THEN 'x' || repeat('9', c_custkey % 60 + 1)
                        WHEN 3 THEN 'X' || c_custkey || repeat('0', c_custkey % 30)
                        WHEN 4 THEN 'Brand#' || (c_custkey % 40)
                        ELSE c_custkey::VARCHAR END AS name,
                   ['BRAND', 'BRAND', 'X', 'X', 'BRAND#', ''][c_custkey % 6 + 1] AS prefix,
                   CASE WHEN c_custkey % 6 IN (0, 1, 4) THEN (c_custkey % 40)::VARCHAR
                        WHEN c_custkey % 6 = 2 THEN repeat('9', c_custkey % 60 + 1)
                        WHEN c_custkey % 6 = 3 THEN c_custkey || repeat('0', c_custkey % 30)
                        ELSE c_custkey::VARCHAR END AS digits,
                   CASE WHEN c_custkey % 6 = 1 THEN c_custkey % 7 ELSE -1 END AS suffix
            FROM customer)""",
    "user_brand_items": """
        SELECT user_id, brand_id AS id, name, content_type
        FROM (SELECT DISTINCT * FROM users_brands) JOIN brands USING (brand_id)""",
    "user_group_items": """
        SELECT user_id, group_id AS id, name, content_type
        FROM (SELECT DISTINCT * FROM users_groups) JOIN groups_ USING (group_id)""",
    "user_provider_items": """
        SELECT DISTINCT user_id, provider_id AS id, p.name, b.content_type
        FROM users_brands JOIN brands b USING (brand_id)
        JOIN providers_brands USING (brand_id) JOIN providers p USING (provider_id)""",
    "second_brands": """
        SELECT brand_id FROM brands WHERE (name, content_type) IN (
            SELECT (replace(brand, '#', ' '), content_type) FROM viewing WHERE lower(x1_user_type) = 'introtv')""",
    "second_product_users": """
        SELECT DISTINCT user_id FROM users_brands JOIN second_brands USING (brand_id)""",
}


def _sql(body: str) -> str:
    """The statement with the derived tables it needs, in order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(_CTES[name])
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in _CTES if name in needed)
    return f"WITH {ctes}\n{body}" if ctes else body


_YEAR = "e.event_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
_SUMS = ", ".join(
    f"CAST(sum(e.{name}) AS BIGINT) AS {name}"
    for name in (
        "content_starts", "pct25_viewed", "pct50_viewed", "pct75_viewed",
        "pct95_viewed", "pct100_viewed", "total_seconds_viewed",
    )
)


def _performance(where: str = "", starts_key: str = ", e.content_starts") -> str:
    return f"""
        SELECT CASE WHEN lower(e.x1_user_type) = 'introtv' THEN 'NOWTV' ELSE 'TVE' END
                    AS product,
               e.platform, a.brand, e.event_date, a.series_name, a.episode_name,
               a.asset_id, {_SUMS}, e.x1_user_type
        FROM summary_daily e JOIN assets a ON a.asset_id = e.asset_id
        WHERE e.content_type = 'OnDemand' AND e.platform IN ('Web', 'Mobile')
          AND {_YEAR} AND e.gracenote_id IS NULL {where}
        GROUP BY e.platform, a.brand, e.event_date, a.series_name, a.episode_name,
                 e.x1_user_type, a.asset_id {starts_key}"""


_EVENT_ASSET_KEY = "md5(" + " || ".join(
    f"length({name}) || ':' || {name}"
    for name in ("brand", "series_title", "season_number", "episode_number", "episode_name")
) + ")"
_TIES = (
    "product, platform, brand, event_date, series_name, episode_name, asset_id,"
    " content_starts, pct25_viewed, pct50_viewed, pct75_viewed, pct95_viewed,"
    " pct100_viewed, total_seconds_viewed, x1_user_type"
)


def _export(
    grain: str, content_type: str, metrics: str, gracenote: str = "IS NOT NULL",
    hidden: str = "x1_user_type", where: str = "",
) -> str:
    shown = f"""e.platform, e.brand, e.event_date, a.series_name, a.episode_name,
        a.episode_number, a.season_number, a.program_type, a.rating, e.total_duration,
        a.available_date, e.air_date, a.expiration_date, e.gracenote_id, {metrics}"""
    hidden_keys = f", {hidden}" if hidden else ""
    null_test = f"AND e.gracenote_id {gracenote}" if gracenote else ""
    return f"""
        SELECT product, platform, brand, event_date, series_name, episode_name,
               episode_number, season_number, program_type, rating, total_duration,
               available_date, air_date, expiration_date, gracenote_id,
               {metrics.replace('e.', '')}
        FROM (
            SELECT DISTINCT
                   CASE WHEN lower(e.x1_user_type) = 'introtv' THEN 'NOW TV' ELSE 'TVE' END
                        AS product, {shown}{hidden_keys}
            FROM summary_{grain} e JOIN assets a ON a.asset_id = e.asset_id
            WHERE e.content_type = '{content_type}' AND {_YEAR} {null_test} {where})"""


_PERFORMANCE = (
    "e.content_starts, e.pct25_viewed, e.pct50_viewed, e.pct75_viewed, e.pct95_viewed,"
    " e.pct100_viewed, e.total_seconds_viewed"
)
_LIVE = "e.unique_devices, e.content_starts, e.total_seconds_viewed"
_SECOND = "AND lower(e.x1_user_type) = 'introtv'"
_ITEM = "struct_pack(id := id, name := name, content_type := content_type)"


def _items(table: str, content_type: str | None = None, item: str = _ITEM) -> str:
    """JSON array of a user's items, by name and id."""
    only = f"AND i.content_type = '{content_type}'" if content_type else ""
    return f"""coalesce((SELECT CAST(to_json(list({item} ORDER BY name, id)) AS VARCHAR)
        FROM {table} i WHERE i.user_id = u.user_id {only}), '[]')"""


def _ids(table: str, content_type: str, text: str = "CAST(id AS VARCHAR)") -> str:
    return f"""coalesce((SELECT string_agg({text}, ',' ORDER BY name, id)
        FROM {table} i WHERE i.user_id = u.user_id AND i.content_type = '{content_type}'), '')"""


_PROVIDER = "struct_pack(id := id, name := name)"
_RECORD = f"""
    SELECT CAST(u.user_id AS INTEGER) AS id, u.name, u.email,
           coalesce(u.is_active, false) AS "isActive", false AS "isDuplicate",
           (SELECT CAST(to_json([struct_pack(id := r.role_id, name := r.name, label := r.label)])
                   AS VARCHAR)
            FROM users_roles ur JOIN roles r USING (role_id) WHERE ur.user_id = u.user_id)
               AS roles,
           (SELECT r.name FROM users_roles ur JOIN roles r USING (role_id)
            WHERE ur.user_id = u.user_id) AS "rolesConcat",
           {_items("user_brand_items")} AS brands,
           {_items("user_brand_items", "Live")} AS "liveStreamBrands",
           {_ids("user_brand_items", "Live")} AS "liveStreamBrandsConcat",
           {_items("user_brand_items", "OnDemand")} AS "vodBrands",
           {_ids("user_brand_items", "OnDemand", "id || '|' || id")} AS "vodBrandsConcat",
           {_items("user_group_items")} AS groups,
           {_items("user_group_items", "Live")} AS "liveStreamGroups",
           {_ids("user_group_items", "Live")} AS "liveStreamGroupsConcat",
           {_items("user_group_items", "OnDemand")} AS "vodGroups",
           {_ids("user_group_items", "OnDemand")} AS "vodGroupsConcat",
           '[]' AS providers,
           {_items("user_provider_items", "Live", _PROVIDER)} AS "liveStreamProviders",
           {_items("user_provider_items", "OnDemand", _PROVIDER)} AS "vodProviders",
           u.user_id IN (SELECT user_id FROM second_product_users) AS nowtv,
           CASE WHEN u.user_id IN (SELECT user_id FROM second_product_users)
                THEN '["TVE","NOWTV"]' ELSE '["TVE"]' END AS "productOptions",
           0 AS part, 1 AS parts
    FROM users u"""


def _group_documents(where: str = "") -> str:
    return f"""
    SELECT g.group_id AS id, g.name, g.content_type,
           coalesce((SELECT CAST(to_json(list(struct_pack(
                        id := b.brand_id, name := b.name || '(' || b.brand_id || ')',
                        content_type := b.content_type) ORDER BY b.name, b.brand_id)) AS VARCHAR)
                     FROM groups_brands gb JOIN brands b USING (brand_id)
                     WHERE gb.group_id = g.group_id), '[]') AS brands,
           coalesce((SELECT CAST(to_json(list(struct_pack(
                        id := x.user_id, name := x.name, email := x.email,
                        active := x.is_active) ORDER BY x.name, x.user_id)) AS VARCHAR)
                     FROM (SELECT DISTINCT ug.group_id, v.* FROM users_groups ug
                           JOIN users v USING (user_id)) x
                     WHERE x.group_id = g.group_id), '[]') AS users,
           0 AS part, 1 AS parts
    FROM groups_ g {where}"""


def _count_by(table: str, test: str) -> str:
    return f"(SELECT count(*) FROM {table} x WHERE {test})"


def _old_count(table: str, where: str = "") -> str:
    return f"""(SELECT count(*) FROM {table} x JOIN legacy_users o ON o.id = x.user_id
                AND o.email = u.email {where})"""


_NATURAL_KEY = r"""array_to_string(list_transform(
    regexp_extract_all(upper(regexp_replace(name, '\s+', '', 'g')), '(\d+|\D+)', 1),
    lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
        THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\1')) AS VARCHAR), 6, '0')
             || regexp_replace(x, '^0+([0-9])', '\1')
        ELSE x END), '')"""

_ID_TEXT = """CASE WHEN brand_id % 5 = 0 THEN ''
    WHEN brand_id % 5 = 1 THEN brand_id || '|' || brand_id || ', 7|7,x'
    ELSE brand_id || ',46,34' END"""

_QUERIES = {
    "vod_performance_table": _performance("AND lower(e.x1_user_type) = 'introtv'"),
    "vod_performance_totals": _performance(
        "AND a.series_name ILIKE '%promo%' AND a.episode_name ILIKE '%r%'", ""
    ),
    "vod_performance_page": f"""
        SELECT * FROM ({_performance()})
        ORDER BY total_seconds_viewed DESC NULLS FIRST,
                 {', '.join(f'{c} ASC NULLS LAST' for c in _TIES.split(', '))}
        LIMIT 100 OFFSET 100""",
    "vod_performance_page_after": f"""
        SELECT * FROM ({_performance()})
        WHERE brand > 'Brand#13'
           OR (brand = 'Brand#13' AND event_date < DATE '1998-06-30')
           OR (brand = 'Brand#13' AND event_date = DATE '1998-06-30' AND product = 'TVE'
               AND (platform > 'Web' OR (platform = 'Web' AND (series_name > 'M'
                    OR (series_name = 'M' AND episode_name >= 'm')))))
        ORDER BY brand NULLS LAST, event_date DESC NULLS FIRST,
                 {', '.join(f'{c} ASC NULLS LAST' for c in _TIES.split(', '))}
        LIMIT 100""",
    "vod_performance_count": f"""SELECT count(*) AS rows FROM ({_performance()})""",
    "vod_performance_of_brand_ids": _export(
        "daily", "OnDemand", _PERFORMANCE, hidden="",
        where="AND a.brand IN (SELECT replace(name, ' ', '#') FROM brands"
              " WHERE brand_id IN (3, 8, 48, 60))",
    ),
    "vod_performance_chart": f"""
        SELECT CASE WHEN lower(e.x1_user_type) = 'introtv' THEN 'NOWTV' ELSE 'TVE' END
                    AS product,
               CAST(replace(CAST(e.event_date AS VARCHAR), '-', '') AS INTEGER) AS date_key,
               CAST(sum(e.content_starts) AS BIGINT) AS "totalStarts"
        FROM summary_daily e JOIN assets a ON a.asset_id = e.asset_id
        WHERE a.brand IN ('Brand#1', 'Brand#7', 'Brand#20') AND e.content_type = 'OnDemand'
          AND e.platform IN ('Web', 'Mobile') AND {_YEAR} AND e.gracenote_id IS NULL
        GROUP BY 1, 2""",
    "vod_performance_export": _export(
        "daily", "OnDemand", _PERFORMANCE, hidden="",
        where="AND a.series_name ILIKE '%o%'"
              " AND (lower(e.x1_user_type) <> 'introtv' OR e.x1_user_type IS NULL)",
    ),
    "vod_performance_export_by_user_type": _export(
        "daily", "OnDemand", _PERFORMANCE, where="AND e.platform = 'Web'"
    ),
    "vod_unique_daily": _export("daily", "OnDemand", "e.content_starts", where=_SECOND),
    "vod_unique_daily_devices": _export(
        "daily", "OnDemand", "e.unique_devices", hidden="x1_user_type, e.content_starts",
        where=_SECOND,
    ),
    "vod_unique_weekly": _export(
        "weekly", "OnDemand", "e.content_starts", "", "x1_user_type, e.unique_devices"
    ),
    "vod_unique_monthly": _export(
        "monthly", "OnDemand", "e.unique_devices", "", "x1_user_type, e.content_starts"
    ),
    "live_unique_daily": _export(
        "daily", "Live", _LIVE, where="AND e.platform IN ('Web', 'Connected')"
    ),
    "live_unique_weekly": _export("weekly", "Live", _LIVE),
    "live_unique_monthly": _export("monthly", "Live", _LIVE),
    "live_unique_monthly_entitled": _export(
        "monthly", "Live", _LIVE,
        where="AND a.brand IN (SELECT 'Brand#' || (s_suppkey % 25) FROM supplier"
              " WHERE s_acctbal > 5000)",
    ),
    "merged_events_live": "SELECT * FROM merged_live",
    "merged_events_ondemand": "SELECT * FROM merged_ondemand",
    "merged_events_all": "SELECT * FROM merged_events",
    "device_exclusion_antijoin": """
        SELECT e.event_id, e.device_id, e.program_id FROM raw_events e
        LEFT JOIN excluded x ON x.device_id = e.device_id AND x.program_id = e.program_id
        WHERE e.entity_type = 'Live' AND x.device_id IS NULL""",
    "completion_flags": """
        SELECT event_id,
               CASE WHEN pct > 25 THEN 1 ELSE 0 END AS pct25_viewed,
               CASE WHEN pct > 50 THEN 1 ELSE 0 END AS pct50_viewed,
               CASE WHEN pct > 75 THEN 1 ELSE 0 END AS pct75_viewed,
               CASE WHEN pct > 95 THEN 1 ELSE 0 END AS pct95_viewed,
               CASE WHEN pct >= 100 THEN 1 ELSE 0 END AS pct100_viewed
        FROM dated_events""",
    "platform_bucket": """
        SELECT event_id, bucket AS platform, coalesce(nullif(company, ''), 'N/A') AS brand,
               coalesce(duration_secs, 0) AS duration_secs,
               CASE WHEN lower(x1_user_type) = 'introtv' THEN 'NOW TV' ELSE 'TVE' END AS product
        FROM dated_events""",
    "event_day_est": """
        SELECT event_id, event_day, CAST(strftime(event_day, '%Y%m%d') AS INTEGER) AS date_key,
               CAST(replace(CAST(event_day AS VARCHAR), '-', '') AS INTEGER)
                   AS date_key_of_text,
               CAST(date_trunc('week', event_day) AS DATE) AS week,
               CAST(date_trunc('month', event_day) AS DATE) AS month
        FROM dated_events""",
    "local_day_range": """
        SELECT event_id, event_timestamp FROM dated_events
        WHERE event_day BETWEEN DATE '2024-01-09' AND DATE '2024-01-11'""",
    "local_day_start": """
        SELECT o_orderkey, starts_at, next_at - starts_at AS seconds
        FROM (SELECT o_orderkey,
                     CAST(epoch(date_trunc('day', o_orderdate) AT TIME ZONE 'EST5EDT')
                          AS BIGINT) AS starts_at,
                     CAST(epoch((date_trunc('day', o_orderdate) + INTERVAL 1 DAY)
                          AT TIME ZONE 'EST5EDT') AS BIGINT) AS next_at
              FROM orders)""",
    "rollup_daily": "SELECT * FROM summary_daily",
    "rollup_weekly": "SELECT * FROM summary_weekly",
    "rollup_monthly": "SELECT * FROM summary_monthly",
    "rollup_daily_from_device_days": "SELECT * FROM summary_daily",
    "rollup_conformed_events": f"""
        SELECT eventdate AS event_date, {_EVENT_ASSET_KEY} AS asset_id, platform, brand, content_type, x1_user_type,
               nullif(gracenote_id, 'N/A') AS gracenote_id,
               max(duration_secs) AS total_duration, airdate AS air_date,
               count(*) AS content_starts,
               CAST(sum(pct25_viewed) AS BIGINT) AS pct25_viewed,
               CAST(sum(pct50_viewed) AS BIGINT) AS pct50_viewed,
               CAST(sum(pct75_viewed) AS BIGINT) AS pct75_viewed,
               CAST(sum(pct95_viewed) AS BIGINT) AS pct95_viewed,
               CAST(sum(pct100_viewed) AS BIGINT) AS pct100_viewed,
               CAST(sum(viewed_secs) AS BIGINT) AS total_seconds_viewed,
               count(DISTINCT device_id) AS unique_devices
        FROM merged_events
        GROUP BY eventdate, platform, brand, content_type, x1_user_type, gracenote_id,
                 series_title, season_number, episode_number, episode_name, airdate""",
    "event_report_daily": """
        SELECT DISTINCT CASE WHEN lower(x1_user_type) = 'introtv' THEN 'NOW TV' ELSE 'TVE' END AS product,
               platform, brand, eventdate AS event_date, series_title AS series_name, episode_name,
               episode_number, season_number, CAST(NULL AS VARCHAR) AS program_type,
               CAST(NULL AS VARCHAR) AS rating, max(duration_secs) AS total_duration,
               CAST(NULL AS VARCHAR) AS available_date, airdate AS air_date,
               CAST(NULL AS VARCHAR) AS expiration_date, gracenote_id,
               count(DISTINCT device_id) AS unique_devices, count(*) AS content_starts,
               CAST(sum(viewed_secs) AS BIGINT) AS total_seconds_viewed
        FROM merged_events
        WHERE content_type = 'Live' AND gracenote_id <> 'N/A'
        GROUP BY platform, brand, eventdate, series_title, episode_name, episode_number, season_number,
                 airdate, gracenote_id, x1_user_type""",
    "event_report_performance": f"""
        SELECT CASE WHEN lower(x1_user_type) = 'introtv' THEN 'NOWTV' ELSE 'TVE' END AS product,
               platform, brand, eventdate AS event_date, series_title AS series_name, episode_name,
               {_EVENT_ASSET_KEY} AS asset_id, count(*) AS content_starts,
               CAST(sum(pct25_viewed) AS BIGINT) AS pct25_viewed,
               CAST(sum(pct50_viewed) AS BIGINT) AS pct50_viewed,
               CAST(sum(pct75_viewed) AS BIGINT) AS pct75_viewed,
               CAST(sum(pct95_viewed) AS BIGINT) AS pct95_viewed,
               CAST(sum(pct100_viewed) AS BIGINT) AS pct100_viewed,
               CAST(sum(viewed_secs) AS BIGINT) AS total_seconds_viewed, x1_user_type
        FROM merged_events
        WHERE content_type = 'OnDemand' AND gracenote_id = 'N/A' AND platform IN ('Web', 'Mobile')
        GROUP BY platform, brand, eventdate, series_title, episode_name, season_number, episode_number,
                 x1_user_type""",
    "merged_events_incremental": " UNION ALL ".join(
        _CTES[f"merged_{name}"].replace("recent_events", "events_of_two_runs") for name in ("live", "ondemand")
    ),
    "unique_devices_by_grain": " UNION ALL ".join(
        f"""SELECT '{grain}' AS grain, {day} AS event_date, brand, content_type,
                   count(DISTINCT device_id) AS unique_devices
            FROM viewing GROUP BY {day}, brand, content_type"""
        for grain, day in (
            ("daily", "event_date"),
            ("weekly", "CAST(date_trunc('week', event_date) AS DATE)"),
            ("monthly", "CAST(date_trunc('month', event_date) AS DATE)"),
        )
    ),
    "unique_devices_by_sketch": """
        SELECT CAST(date_trunc('month', event_date) AS DATE) AS event_date, brand,
               content_type, count(DISTINCT device_id) AS unique_devices, true AS is_close
        FROM viewing GROUP BY 1, 2, 3""",
    "product_backfill": """
        SELECT * REPLACE (
            CASE WHEN event_date BETWEEN DATE '1998-05-01' AND DATE '1998-07-31'
                      AND brand IN ('Brand#1', 'Brand#2', 'Brand#3')
                 THEN CASE WHEN pct100_viewed > 0 THEN '' ELSE 'introtv' END
                 ELSE x1_user_type END AS x1_user_type)
        FROM summary_daily""",
    "brand_activity": """
        SELECT brand, content_type, min(event_date) AS min_event_date,
               max(event_date) AS max_event_date, count(*) AS event_count
        FROM summary_daily WHERE event_date >= DATE '1999-01-01'
        GROUP BY brand, content_type""",
    "brands_by_group": """
        SELECT g.group_id, g.name AS group_name, g.content_type AS group_content_type,
               (SELECT count(*) FROM users_groups ug WHERE ug.group_id = g.group_id)
                   AS count_group_users,
               b.brand_id, b.name AS brand_name, b.content_type AS brand_content_type,
               (SELECT count(ub.user_id) FROM users_brands ub WHERE ub.brand_id = b.brand_id)
                   AS count_brand_users,
               (SELECT count(*) FROM summary_daily s
                WHERE replace(s.brand, '#', ' ') = b.name AND s.content_type = b.content_type
                  AND s.event_date >= DATE '1999-01-01') AS count_events_last_90d
        FROM brands b
        LEFT JOIN groups_brands gb ON gb.brand_id = b.brand_id
        LEFT JOIN groups_ g ON g.group_id = gb.group_id""",
    "providers_brands": """
        SELECT p.provider_id, p.name AS provider_name, b.brand_id, b.name AS brand_name,
               b.content_type AS brand_content_type
        FROM providers_brands pb JOIN brands b ON b.brand_id = pb.brand_id
        JOIN providers p ON p.provider_id = pb.provider_id""",
    "access_by_domain": """
        SELECT DISTINCT u.user_id, u.email AS user_email, u.name AS user_name,
               u.is_active AS user_active, g.group_id, g.name AS group_name,
               g.content_type AS group_content_type, b.brand_id, b.name AS brand_name,
               b.content_type AS brand_content_type
        FROM users u
        LEFT JOIN users_groups ug ON ug.user_id = u.user_id
        LEFT JOIN groups_brands gb ON gb.group_id = ug.group_id
        LEFT JOIN brands b ON b.brand_id = gb.brand_id
        LEFT JOIN groups_ g ON g.group_id = ug.group_id
        WHERE u.email ILIKE '%building%' OR u.email ILIKE '%auto%'""",
    "legacy_access_union": " UNION ALL ".join(
        f"""SELECT u.id AS user_id, u.email AS user_email, u.name AS user_name,
                   u.is_active AS user_active, g.id AS group_id, g.name AS group_name,
                   '{content_type}' AS group_content_type, g.description
            FROM legacy_users u
            LEFT JOIN (SELECT * FROM legacy_users_groups WHERE group_id % 2 = {parity}) ug
                   ON ug.user_id = u.id
            LEFT JOIN legacy_groups g ON g.id = ug.group_id
            WHERE u.email ILIKE '%building%' OR u.email ILIKE '%auto%'"""
        for content_type, parity in (("Live", 0), ("OnDemand", 1))
    ),
    "system_comparison": f"""
        SELECT u.user_id, u.name, u.email,
               CASE WHEN u.is_active THEN 'Yes' ELSE 'No' END AS is_active,
               CASE WHEN u.password IS NOT NULL THEN 'Yes' ELSE 'No' END AS password_set,
               {_old_count("legacy_users_roles")} AS old_count_roles,
               {_count_by("users_roles", "x.user_id = u.user_id")} AS new_count_roles,
               {_old_count("legacy_users_groups", "WHERE x.group_id % 2 = 1")}
                   AS old_count_groups,
               {_count_by("users_groups", "x.user_id = u.user_id")} AS new_count_groups,
               {_old_count("legacy_users_brands")} AS old_count_explicit_brands,
               {_count_by("users_brands", "x.user_id = u.user_id")}
                   AS new_count_explicit_brands
        FROM users u""",
    "user_search": """
        SELECT * FROM users WHERE name ILIKE '%000012%' AND email IS NOT NULL""",
    "user_search_either": """
        SELECT * FROM users WHERE name ILIKE '%99%' OR email ILIKE '%@MACHINERY%'""",
    "user_search_indexed": """
        SELECT 'name 000012 ' AS search, * FROM users WHERE name ILIKE '%000012%' AND email IS NOT NULL
        UNION ALL
        SELECT 'name R#00_0001 ', * FROM users WHERE name ILIKE '%r#00_0001%' AND email IS NOT NULL
        UNION ALL SELECT 'name 1 ', * FROM users WHERE name ILIKE '%1%' AND email IS NOT NULL
        UNION ALL
        SELECT 'both 00001 @bu%ing', * FROM users WHERE name ILIKE '%00001%' AND email ILIKE '%@bu%ing%'
        UNION ALL SELECT 'both 7 FURN', * FROM users WHERE name ILIKE '%7%' AND email ILIKE '%furn%'
        UNION ALL
        SELECT 'either 00099 @MACHINERY', * FROM users WHERE name ILIKE '%00099%' OR email ILIKE '%@machinery%'
        UNION ALL
        SELECT 'either 99 @MACHINERY', * FROM users WHERE name ILIKE '%99%' OR email ILIKE '%@machinery%'""",
    "users_where": """
        SELECT * FROM users WHERE email ILIKE '%@b%' AND is_active AND user_id >= 100""",
    "brands_by_name": "SELECT * FROM brands WHERE name IN ('Brand 3', 'Brand 30', 'None')",
    "legacy_user_by_email": """
        SELECT * FROM legacy_users WHERE email = 'u9@building.example'
        UNION ALL
        SELECT * FROM legacy_users WHERE name = 'Customer#000000010'""",
    "roles_in_order": "SELECT * FROM roles",
    "users_page": "SELECT * FROM users ORDER BY user_id LIMIT 3 OFFSET 6",
    "user_by_email": """
        SELECT * FROM users
        WHERE email LIKE 'u7@%' AND is_active OR email LIKE 'u12@%' AND is_active IS NOT NULL""",
    "entitled_brands_of_user": """
        SELECT 30 AS user_id, brand_id, name, content_type FROM brands
        WHERE brand_id IN (SELECT brand_id FROM users_brands WHERE user_id = 30)
           OR brand_id IN (SELECT gb.brand_id FROM users_groups JOIN groups_brands gb USING (group_id)
                           WHERE user_id = 30)""",
    "vod_performance_sorted_page": f"""
        SELECT * FROM ({_performance()})
        ORDER BY episode_name DESC NULLS FIRST,
                 {', '.join(f'{c} ASC NULLS LAST' for c in _TIES.split(', '))}
        LIMIT 100""",
    "csv_export_read_back": """
        SELECT product AS "Product", platform AS "Platform", nullif(brand, '') AS "Brand",
               CAST(event_date AS VARCHAR) AS "Date", series_name AS "Series Title",
               episode_name AS "Video Title", episode_number AS "Episode #", season_number AS "Season #",
               program_type AS "XTV Video Category", rating AS "Rating",
               CAST(total_duration AS VARCHAR) AS "Length", available_date AS "Available Date",
               air_date AS "Air Date", expiration_date AS "Expiration Date",
               gracenote_id AS "Provider External ID", CAST(unique_devices AS VARCHAR) AS "Unique Visitors",
               CAST(content_starts AS VARCHAR) AS "Live Video Starts",
               CAST(total_seconds_viewed AS VARCHAR) AS "Viewing Time", CAST(NULL AS VARCHAR) AS "NOTE",
               'metrics_19980101-19981231' AS file
        FROM (""".replace("NOTE", (
            "Please note that the daily unique visitor metrics are not additive towards"
            " either a weekly or monthly unique visitor metric. For weekly or monthly"
            " unique visitor data, please run a weekly or monthly report, which will"
            " include de-duplicated weekly and monthly unique metrics."
        )) + _export("daily", "Live", _LIVE, where="AND e.platform IN ('Web', 'Connected')") + ")",
    "request_days": """
        SELECT o_orderkey, d + [0, -1, 1, 0, 0, 0][o_orderkey % 6 + 1] AS first_day,
               d + [-2, -2, 0, -1, 0, 0][o_orderkey % 6 + 1] AS last_day,
               CASE WHEN o_orderkey % 11 <> 0
                    THEN CAST(epoch_ms((o_orderkey * 7919000777) % 4000000000000 - 1000000000000) AS DATE) END AS epoch_day
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "document_children": """
        SELECT user_id, kind, row_number() OVER (PARTITION BY user_id, kind ORDER BY name, id) - 1 AS position,
               id, name, content_type
        FROM (
            SELECT CASE content_type WHEN 'Live' THEN 'live_stream_brands' ELSE 'vod_brands' END AS kind, *
            FROM user_brand_items
            UNION ALL
            SELECT CASE content_type WHEN 'Live' THEN 'live_stream_groups' ELSE 'vod_groups' END, *
            FROM user_group_items)""",
    "second_product_brands": "SELECT brand_id FROM second_brands",
    "natural_sort_rank": """
        SELECT user_id, name,
               dense_rank() OVER (ORDER BY prefix || '0', length(plain), plain, suffix) AS rank
        FROM numbered_names""",
    "requested_id_list": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 3 <> 0 THEN c_custkey || ' 5' ELSE '0' END
               || CASE WHEN c_custkey % 4 <> 0 THEN ' 7 ' || c_custkey ELSE '' END AS ids
        FROM customer""",
    "membership_sync_from_lists": """
        (SELECT user_id, brand_id FROM users_brands UNION SELECT * FROM listed)
        EXCEPT SELECT user_id, brand_id FROM unlisted""",
    "groups_of_user": """
        SELECT * FROM groups_
        WHERE group_id IN (SELECT group_id FROM users_groups WHERE user_id = 30)""",
    "canonical_brands": """
        SELECT name, content_type, min(brand_id) AS brand_id FROM brands
        GROUP BY name, content_type""",
    "brand_names": """
        SELECT name FROM brands WHERE brand_id BETWEEN 5 AND 59 AND brand_id % 5 = 0""",
    "entitled_brands": """
        SELECT DISTINCT x.user_id, b.brand_id, b.name, b.content_type
        FROM (SELECT user_id, brand_id FROM users_brands
              UNION ALL
              SELECT user_id, brand_id FROM users_groups JOIN groups_brands USING (group_id)) x
        JOIN brands b ON b.brand_id = x.brand_id WHERE b.content_type = 'OnDemand'""",
    "roles_by_name": """
        SELECT DISTINCT user_id, role_id
        FROM (SELECT o_custkey AS user_id, min(o_orderpriority) AS lowest
              FROM orders GROUP BY o_custkey) o
        JOIN roles r ON (lowest = '1-URGENT' AND r.name IN ('BUILDING', 'MACHINERY'))
                     OR (lowest <> '1-URGENT' AND r.name = 'FURNITURE')""",
    "user_documents": f"""
        SELECT u.user_id AS id, u.is_active, u.name, u.email,
               (SELECT CAST(to_json(struct_pack(id := r.role_id, name := r.name,
                       label := r.label)) AS VARCHAR)
                FROM users_roles ur JOIN roles r USING (role_id)
                WHERE ur.user_id = u.user_id) AS role,
               {_items("user_brand_items", "OnDemand")} AS vod_brands,
               {_items("user_group_items", "OnDemand")} AS vod_groups,
               {_items("user_brand_items", "Live")} AS live_stream_brands,
               {_items("user_group_items", "Live")} AS live_stream_groups,
               0 AS part, 1 AS parts
        FROM users u""",
    "group_documents": _group_documents(),
    "group_documents_live": _group_documents("WHERE g.content_type = 'Live'"),
    "brand_documents": """
        SELECT b.brand_id AS id, b.name, b.content_type,
               coalesce((SELECT CAST(to_json(list(struct_pack(
                            id := o.brand_id, name := o.name || '(' || o.brand_id || ')',
                            content_type := o.content_type) ORDER BY o.name, o.brand_id))
                            AS VARCHAR)
                         FROM brands_brands bb JOIN brands o ON o.brand_id = bb.linked_brand_id
                         WHERE bb.brand_id = b.brand_id), '[]') AS brands,
               coalesce((SELECT CAST(to_json(list(struct_pack(
                            id := v.user_id, name := v.name, email := v.email,
                            active := v.is_active) ORDER BY v.name, v.user_id)) AS VARCHAR)
                         FROM users_brands ub JOIN users v USING (user_id)
                         WHERE ub.brand_id = b.brand_id), '[]') AS users,
               0 AS part, 1 AS parts
        FROM brands b""",
    "user_records": _RECORD,
    "short_user_records": f"""
        SELECT name, "rolesConcat" AS roles, brands, "liveStreamBrands",
               "liveStreamBrandsConcat", "vodBrands", "vodBrandsConcat", nowtv,
               "productOptions", part, parts
        FROM ({_RECORD})""",
    "option_list": """
        SELECT 'brand' AS kind, name AS label, min(brand_id) AS value FROM brands
        WHERE content_type = 'OnDemand' GROUP BY name
        UNION ALL
        SELECT 'group', name, group_id FROM groups_ WHERE content_type = 'Live'
        UNION ALL
        SELECT 'user', name || ' (' || email || ')', user_id FROM users""",
    "natural_sort_key": f"""
        SELECT name, {_NATURAL_KEY} AS sort_key FROM users
        UNION ALL
        SELECT name, {_NATURAL_KEY} FROM brands""",
    "id_list_parse": f"""
        SELECT brand_id, {_ID_TEXT} AS list,
               CASE WHEN brand_id % 5 = 0 THEN '0'
                    WHEN brand_id % 5 = 1 THEN brand_id || ' 7 0'
                    ELSE brand_id || ' 46 34' END AS ids
        FROM brands""",
    "word_list_parse": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 THEN 'Web/Mobile'
                               ELSE replace(trim(p_name), ' ', '/') END AS words
        FROM part""",
    "membership_diff": """
        SELECT 'delete' AS action, user_id, brand_id FROM removed
        UNION ALL SELECT 'insert', user_id, brand_id FROM added""",
    "membership_diff_in_scope": """
        SELECT 'delete' AS action, user_id, brand_id FROM removed
        WHERE user_id IN (SELECT user_id FROM users WHERE email LIKE '%@building%')
        UNION ALL
        SELECT 'insert', user_id, brand_id FROM added
        WHERE user_id IN (SELECT user_id FROM users WHERE email LIKE '%@building%')""",
    "membership_delete_expansion": """
        SELECT DISTINCT ub.user_id, ub.brand_id FROM users_brands ub
        JOIN expanded x ON x.user_id = ub.user_id AND x.brand_id = ub.brand_id""",
    "membership_sync": """
        (SELECT user_id, brand_id FROM users_brands
         UNION SELECT user_id, brand_id FROM added JOIN typed_brands USING (brand_id) WHERE content_type <> 'Radio')
        EXCEPT SELECT user_id, brand_id FROM typed_expanded""",
    "membership_sync_groups_brands": """
        SELECT group_id, brand_id FROM groups_brands WHERE brand_id % 5 <> 0
        UNION
        SELECT brand_id % 25, brand_id FROM brands WHERE brand_id % 10 = 0""",
    "membership_sync_groups_users": """
        SELECT group_id, user_id FROM users_groups
        EXCEPT
        SELECT g.group_id, r.user_id FROM users_groups r
        JOIN groups_ g ON g.group_id % 10 = r.group_id % 10
        WHERE (r.user_id + r.group_id) % 4 = 0""",
    "membership_clear": """
        SELECT ub.user_id, ub.brand_id
        FROM users_brands ub JOIN brands b USING (brand_id) JOIN users u USING (user_id)
        WHERE NOT (b.content_type = 'Live' AND coalesce(u.is_active = false, false))""",
    "role_upsert": """
        SELECT user_id, role_id FROM users_roles WHERE user_id % 4 <> 0 AND user_id % 6 <> 0
        UNION ALL
        SELECT user_id, user_id % 5 + 1 FROM users WHERE user_id % 6 = 0""",
    "group_upsert": """
        SELECT * FROM renamed_groups UNION ALL SELECT * FROM created_groups""",
    "group_upsert_rejects": """
        SELECT seq, group_id, name, content_type, 'not found' AS reason FROM group_changes
        WHERE group_id > 0 AND group_id NOT IN (SELECT group_id FROM groups_)
        UNION ALL
        SELECT seq, group_id, trim(name), content_type, 'name is required' FROM group_changes
        WHERE coalesce(group_id, 0) <= 0 AND coalesce(trim(name), '') = ''""",
    "user_upsert": """
        SELECT u.user_id, coalesce(v[1], u.name) AS name, u.email, coalesce(v[2], u.is_active) AS is_active,
               creation_date, created_by_id,
               CASE WHEN v IS NOT NULL THEN DATE '2024-01-16' ELSE modification_date END AS modification_date,
               CASE WHEN v IS NOT NULL THEN 42 ELSE modified_by_id END AS modified_by_id
        FROM moved_users u LEFT JOIN asked_users a ON a.asked = u.email
             AND u.user_id = (SELECT min(user_id) FROM moved_users m WHERE m.email = u.email)
        UNION ALL
        SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY asked), v[1], asked, v[2],
               DATE '2024-01-16', 42, NULL, NULL
        FROM asked_users WHERE asked NOT IN (SELECT email FROM moved_users)""",
    "user_upsert_rejects": """
        SELECT seq, user_id, name, email, is_active, 'not found' AS reason FROM user_changes
        WHERE user_id > 0 AND user_id NOT IN (SELECT user_id FROM users)
        UNION ALL
        SELECT seq, user_id, name, trim(email), is_active, 'email is required' FROM user_changes
        WHERE coalesce(user_id, 0) <= 0 AND coalesce(trim(email), '') = ''""",
    "created_group_ids": "SELECT * FROM created_groups",
}

ORACLE_SQL = {name: _sql(body) for name, body in _QUERIES.items()}
