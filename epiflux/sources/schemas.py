"""Schemas of the inputs; inference is never used.  Column names follow the published files."""

from __future__ import annotations

TWEET_STREAM = (
    "id string, created_ts string, text string, `user.name` string, location string, "
    "verified string, entities string, RT string, quoted_text string"
)

TWEET_STATUS = (
    "id bigint, created_at string, text string, lang string, "
    "extended_tweet struct<full_text:string>, "
    "retweeted_status struct<id:bigint>, retweet_count bigint, "
    "quoted_status struct<text:string,extended_tweet:struct<full_text:string>>, "
    "user struct<id:bigint,name:string,screen_name:string,location:string,verified:boolean,"
    "utc_offset:int,time_zone:string>, "
    "place struct<country_code:string>, coordinates string, "
    "entities struct<hashtags:array<struct<text:string>>,"
    "user_mentions:array<struct<screen_name:string>>,urls:array<struct<url:string>>>"
)

TWEET_SEARCH = (
    "id bigint, text string, created_ts timestamp, user_id bigint, user_name string, "
    "user_screen_name string, user_location string, user_statuses_count bigint, "
    "user_verified boolean, favorite_count bigint, favorited boolean, retweet_count bigint, "
    "entities string"
)

SENTIMENT_DAILY = "created_dt date, vdr_compound double"
EMOJI_DAILY = "Date date, emoji string, mentions bigint"
HASHTAG_DAILY = "Date date, hashtag string, frequency bigint"
SYMPTOM_DAILY = "date date, symptom_text string, Frequency bigint"
TERM_DAILY = "date date, term string, tweet_volume bigint"
CASES_DAILY = "date date, country_region string, province_state string, deaths bigint"
CASES_COUNTY = "`state-county` string, Date date, Confirmed bigint"

LINELIST = ", ".join(
    f"{name} string"
    for name in (
        "ID age sex city province country admin1 admin2 admin3 latitude longitude geo_resolution "
        "date_onset_symptoms date_admission_hospital date_confirmation date_death_or_discharge "
        "travel_history_dates symptoms chronic_disease chronic_disease_binary outcome "
        "lives_in_Wuhan reported_market_exposure sequence_available"
    ).split()
)

SELF_REPORTS = ", ".join(
    f"{name} string"
    for name in (
        "profileId submissionOrder age sex hasBeenTested hasBeenInContactWithInfected symptomStart "
        "testResult submissionDate bodyTemperature smokingHabit isolationStatus "
        "diagnosedWithOtherConditions DRY_COUGH EXHAUSTION FEVER HEAVY_BREATHING MUSCLE_ACHING "
        "DIARRHEA HEADACHE SORE_THROAT NO_TASTE NO_SMELL SLIME_COUGH RUNNY_NOSE NAUSEA_OR_VOMITING"
    ).split()
)

PLACES_RAW = "user_location string"
GEOCODE_RESULT = (
    "place_queried string, address string, quality string, country string, state string, "
    "county string, city string, lat double, lng double"
)
