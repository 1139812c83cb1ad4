"""Small pages and tables of our own."""

from leafmark.sources.html_tree import shred_html


def thread_list(n=4, plain_author=(), head="", extra_link=False):
    """A page with n thread rows; authors of the rows in ``plain_author`` are not links."""
    rows = []
    for i in range(n):
        name = f"member{'abcdefgh'[i]}"
        author = f'<span class="user">{name}</span>' if i in plain_author else f'<a class="user" href="/u/{i}">{name}</a>'
        more = f'<a href="/threads/{i}/latest">Jump to newest</a>' if extra_link else ""
        rows.append(
            f'<div class="row js-{i}"><div class="main"><a class="subject" href="/threads/{i}">'
            f"How to grow quinces, part {'one two three four five six seven eight'.split()[i]}</a>{more}</div>"
            f'<div class="last"><span>Latest: </span>{author}<time class="when">{i + 2} minutes ago</time></div></div>'
        )
    return (
        "<!DOCTYPE html><html><head><title>Garden talk</title></head><body>"
        f'{head}<nav><ul><li><a href="/">Home</a></li><li><a href="/s">Search</a></li></ul></nav>'
        f'<div class="list">{"".join(rows)}</div><footer>All rights kept</footer></body></html>'
    )


def pages(spark, *htmls, site="https://garden.example"):
    rows = [(i + 1, f"{site}/list/{i + 1}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")


def nodes(spark, *htmls):
    return shred_html(pages(spark, *htmls))


def body(inner):
    return f"<html><head></head><body>{inner}</body></html>"
