from datetime import date

from patronage.llm.url_filter import filter_urls


def test_intervals_and_precedence(spark):
    d = date
    entries = spark.createDataFrame(
        [
            ("example.com", "block", d(2024, 1, 10)), ("example.com", "remove", d(2024, 2, 1)), ("good.example.com", "allow", d(2024, 1, 1)),
            ("example.com", "block", d(2024, 1, 10)), (None, "block", d(2024, 1, 1)), ("x.org", None, d(2024, 1, 1)), ("y.org", "allow", d(2024, 1, 1)), ("y.org", "block", d(2024, 1, 1)),
        ],
        "rule string, action string, listed date",
    )
    rows = [
        (1, "https://www.Example.com/a", d(2024, 1, 9)), (2, "https://www.example.com/a", d(2024, 1, 10)), (3, "http://u@example.com:80", d(2024, 1, 31)),
        (4, "http://example.com", d(2024, 2, 1)), (5, "http://good.example.com/", d(2024, 1, 20)), (6, None, d(2024, 1, 20)), (7, "http://example.com", None),
        (8, "no url", d(2024, 1, 20)), (9, "http://y.org", d(2024, 1, 1)), (9, "http://y.org", d(2024, 1, 1)),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, day date").selectExpr("*", "0 as host", "1 as salt", "2 as rule")
    got = filter_urls(pages, entries, "page_id", "url", "day").collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.rule, r.blocked) for r in got} == {
        1: (None, False), 2: ("example.com", True), 3: ("example.com", True), 4: (None, False), 5: ("good.example.com", False),
        6: (None, False), 7: (None, False), 8: (None, False), 9: ("y.org", True),
    }
    assert filter_urls(pages.where("false"), entries, "page_id", "url", "day").count() == 0
    assert filter_urls(pages, entries.where("false"), "page_id", "url", "day").where("blocked").count() == 0
