"""Hand-written messages."""

CREATED = "Wed May 02 13:08:45 +0000 2018"


def user(uid=7, **changes):
    base = {
        "id": uid,
        "id_str": str(uid),
        "created_at": "Wed Aug 27 13:08:45 +0000 2008",
        "lang": "tr",
        "name": f"Name {uid}",
        "screen_name": f"user{uid}",
        "location": None,
        "description": "a\r\nb",
        "url": None,
        "followers_count": 10,
        "friends_count": 20,
        "favourites_count": 30,
        "listed_count": 4,
        "statuses_count": 50,
        "protected": False,
        "verified": True,
        "default_profile": False,
        "default_profile_image": False,
        "profile_background_image_url_https": "https://bg",
        "profile_image_url_https": "https://img",
        "profile_image_url": "http://img",
        "time_zone": None,
        "utc_offset": None,
    }
    return _changed(base, changes)


def message(mid=1, uid=7, **changes):
    base = {
        "id": mid,
        "created_at": CREATED,
        "text": f"text {mid}",
        "lang": "tr",
        "source": '<a href="http://client.example" rel="nofollow">Client</a>',
        "retweet_count": 1,
        "favorite_count": 2,
        "reply_count": 3,
        "quote_count": 4,
        "in_reply_to_status_id": None,
        "in_reply_to_user_id": None,
        "in_reply_to_screen_name": None,
        "entities": {"hashtags": [], "urls": [], "user_mentions": []},
        "user": user(uid),
    }
    return _changed(base, changes)


ABSENT = object()


def _changed(base, changes):
    out = {**base, **changes}
    return {key: value for key, value in out.items() if value is not ABSENT}


def deletion(mid=5, uid=7, millis="1525266525999"):
    return {"delete": {"status": {"id": mid, "user_id": uid}, "timestamp_ms": millis}}
