"""Addresses of posts and pages: one form for all spellings."""

from tessera.functions import links

CASES = [
    ("https://m.facebook.com/story.php?id=77&story_fbid=123&fbclid=x", "facebook", "https://www.facebook.com/permalink.php?story_fbid=123&id=77", "123", "77", False),
    ("https://www.facebook.com/permalink.php?story_fbid=123", "facebook", "https://www.facebook.com/permalink.php?story_fbid=123", "123", None, False),
    ("http://facebook.com/watch/?v=9&ref=x", "facebook", "https://www.facebook.com/watch?v=9", "9", None, True),
    ("https://fb.watch/abc/", "facebook", "https://fb.watch/abc", "watch-abc", None, True),
    ("https://web.facebook.com/photo.php?fbid=5&set=a", "facebook", "https://www.facebook.com/photo?fbid=5", "5", None, False),
    ("https://facebook.com/share/v/zz/", "facebook", "https://www.facebook.com/share/v/zz", "share-zz", None, True),
    ("https://facebook.com/groups/g1/permalink/8/", "facebook", "https://www.facebook.com/groups/g1/posts/8", "8", "groups/g1", False),
    ("https://facebook.com/apage/videos/some-title/44", "facebook", "https://www.facebook.com/apage/videos/44", "44", "apage", True),
    ("facebook.com/apage/", "facebook", "https://www.facebook.com/apage", None, "apage", False),
    ("https://youtu.be/Vid?t=3", "youtube", "https://www.youtube.com/watch?v=Vid", "Vid", None, True),
    ("https://m.youtube.com/watch?feature=a&v=Vid", "youtube", "https://www.youtube.com/watch?v=Vid", "Vid", None, True),
    ("https://www.youtube.com/shorts/Vid/", "youtube", "https://www.youtube.com/watch?v=Vid", "Vid", None, True),
    ("https://www.youtube.com/@name/videos", "youtube", "https://www.youtube.com/@name/videos", None, "@name", True),
    ("https://mobile.twitter.com/who/status/12?s=20", "x", "https://x.com/who/status/12", "12", "@who", False),
    ("https://x.com/who", "x", "https://x.com/who", None, "@who", False),
    ("https://www.tiktok.com/@who/video/3?lang=en", "tiktok", "https://www.tiktok.com/@who/video/3", "3", "@who", True),
    ("https://vm.tiktok.com/Zz1/", "tiktok", "https://vm.tiktok.com/Zz1", "short-Zz1", None, True),
    ("https://instagram.com/reel/R1/?igsh=a", "instagram", "https://www.instagram.com/reel/R1", "R1", None, True),
    ("https://www.instagram.com/who/", "instagram", "https://www.instagram.com/who", None, "@who", False),
    ("https://t.me/chan/77", "telegram", "https://t.me/chan/77", "chan/77", "chan", False),
    ("https://t.me/chan", "telegram", "https://t.me/chan", None, "chan", False),
    ("  HTTP://User@WWW.Example.org:80/a/b/?z=1&utm_source=q&b=%20x~*&z=2&e=#top ", "web", "https://example.org/a/b?b=+x~%2A&z=1", None, None, False),
    ("https://example.org", "web", "https://example.org/", None, None, False),
    ("https://notx.com/a/status/1?q=100%", "web", "https://notx.com/a/status/1?q=100%25", None, None, False),
]


def test_links(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, url string")
    found = {r["k"]: r["link"] for r in links.with_links(df, "url").collect()}
    for k, (url, platform, canonical, post, account, video) in enumerate(CASES):
        got = found[k]
        assert (got["platform"], got["canonical"], got["post_id"], got["account"], got["video"]) == (platform, canonical, post, account, video), url
        assert got["external_id"] == (f"{platform}:{post}" if post else canonical)


def test_opened_pages_keep_their_host_and_scheme(spark):
    df = spark.createDataFrame([("http://www.Example.org/a/?x=1&ref=y",)], "url string")
    assert links.with_links(df, "url").first()["link"]["opened"] == "http://www.Example.org/a/?x=1"


def test_no_links_and_clashing_columns(spark):
    rows = [(u, 1, 2) for u in (None, "", "ftp://example.org/a", "javascript:alert(1)", "https://localhost/a", "just words", "https://")]
    found = links.with_links(spark.createDataFrame(rows, "url string, host int, row int"), "url", "l")
    assert found.columns == ["url", "host", "row", "l"] and all(r["l"] is None and r["host"] == 1 and r["row"] == 2 for r in found.collect())
    assert links.with_links(spark.createDataFrame([], "url string"), "url").count() == 0
