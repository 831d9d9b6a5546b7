"""Schemas of the tables the engine reads and writes (Spark DDL)."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "raw_events": """
        event_id bigint, event_timestamp bigint, event_datekey int, platform string,
        entity_type string, program_id string, media_guid string, device_id string,
        company string, provider string, series_name string, season_number string,
        episode_number string, episode_name string, airdate string,
        duration_secs bigint, viewed_secs bigint, x1_user_type string""",
    "live_assets": """
        program_id string, entity_type string, tms_episode_id string,
        last_update string""",
    "ondemand_assets": """
        media_guid string, entity_type string, tms_episode_id string,
        last_update string""",
    "live_filtered_devices": """
        device_id string, program_id string, time_diff boolean,
        program_count bigint""",
    "merged_events": """
        content_type string, eventdate date, event_datekey int, platform string,
        brand string, series_title string, season_number string,
        episode_number string, episode_name string, gracenote_id string,
        airdate string, event_id bigint, device_id string, duration_secs bigint,
        viewed_secs bigint, pct25_viewed int, pct50_viewed int, pct75_viewed int,
        pct95_viewed int, pct100_viewed int, x1_user_type string,
        run_day date""",
    # What a conformed event says of its asset, by day; keys are those of `rollup.asset_key`.
    "event_assets": """
        event_date date, brand string, series_name string, season_number string,
        episode_number string, episode_name string, asset_id string""",
    "event_summary": """
        event_date date, asset_id string, platform string, brand string,
        content_type string, x1_user_type string, gracenote_id string,
        total_duration bigint, air_date string, content_starts bigint,
        pct25_viewed bigint, pct50_viewed bigint, pct75_viewed bigint,
        pct95_viewed bigint, pct100_viewed bigint, total_seconds_viewed bigint,
        unique_devices bigint""",
    "summary": """
        event_date date, asset_id bigint, platform string, brand string,
        content_type string, x1_user_type string, gracenote_id string,
        total_duration bigint, air_date string, content_starts bigint,
        pct25_viewed bigint, pct50_viewed bigint, pct75_viewed bigint,
        pct95_viewed bigint, pct100_viewed bigint, total_seconds_viewed bigint,
        unique_devices bigint""",
    "assets": """
        asset_id bigint, brand string, series_name string, episode_name string,
        episode_number string, season_number string, program_type string,
        rating string, available_date string, expiration_date string""",
    "users": "user_id bigint, name string, email string, is_active boolean, password string",
    "groups": "group_id bigint, name string, content_type string",
    "brands": "brand_id bigint, name string, content_type string",
    "roles": "role_id bigint, name string, label string",
    "providers": "provider_id bigint, name string",
    "users_groups": "user_id bigint, group_id bigint",
    "users_brands": "user_id bigint, brand_id bigint",
    "users_roles": "user_id bigint, role_id bigint",
    "groups_brands": "group_id bigint, brand_id bigint",
    "providers_brands": "provider_id bigint, brand_id bigint",
    "brands_brands": "brand_id bigint, linked_brand_id bigint",
    "legacy_users": "id bigint, name string, email string, is_active boolean",
    "legacy_groups": "id bigint, name string, description string",
    "legacy_users_groups": "user_id bigint, group_id bigint",
    "legacy_users_roles": "user_id bigint, role_id bigint",
    "legacy_users_brands": "user_id bigint, brand_id bigint",
}

# One schema serves the three summary grains, and one the legacy group tables
# of both content types.
_ALIASES = {
    "summary_daily": "summary",
    "summary_weekly": "summary",
    "summary_monthly": "summary",
    "event_summary_daily": "event_summary",
    "event_summary_weekly": "event_summary",
    "event_summary_monthly": "event_summary",
    "legacy_live_groups": "legacy_groups",
    "legacy_vod_groups": "legacy_groups",
    "legacy_users_live_groups": "legacy_users_groups",
    "legacy_users_vod_groups": "legacy_users_groups",
}


def schema(table: str) -> StructType:
    """Declared schema of a table."""
    return StructType.fromDDL(_DDL[_ALIASES.get(table, table)])


def tables() -> list[str]:
    return sorted((set(_DDL) - set(_ALIASES.values())) | set(_ALIASES))
