"""HTML sources on small invented pages."""

import datetime

import pytest

from listwright.sources import html_feeds as hf

NOW = datetime.datetime(2024, 1, 31, 12, 0)


def offer_card(n, title, skills=("Rust", "Linux"), age="3 days ago", company="Quill Works"):
    chips = "".join(
        f'<a href="/remote-jobs/{s.lower()}"><div class="line-clamp-1 tip">{s}</div></a>' for s in skills
    )
    return f"""
    <div class="card"><div><div><div><div>
      <a class="t" href="/offer/abc{n}-{title.lower().replace(' ', '-')}?ref=1" title="{title}">{title}</a>
      <div class="age">{age}</div></div></div>
      <p><a href="/remote-jobs/company-quill">{company}</a></p></div>
      <div>Remote from <div><span>Iceland</span></div></div>
      <div><a href="/remote-jobs/full-time">Full time</a></div> <span>$60 - 72 K</span>
      <div>{chips}</div></div></div>"""


def test_offer_cards(spark, landing):
    page = "<main>" + offer_card(1, "Systems Developer") + offer_card(2, "Data Clerk", age="Today") \
        + offer_card(1, "Systems Developer") + "</main>"
    rows = hf.jobgether(landing(("jobgether", "0", page))).orderBy("item_ord").collect()
    assert [r.title for r in rows] == ["Systems Developer", "Data Clerk"]
    r = rows[0]
    assert r.external_id == "abc1"
    assert r.url == "https://jobgether.com/offer/abc1-systems-developer"
    assert r.company == "Quill Works"
    assert r.location == "Iceland"
    assert r.budget == "$60 - 72 K"
    assert r.tags == ["Rust", "Linux", "Full Time"]
    assert r.posted_at == NOW - datetime.timedelta(days=3)
    assert rows[1].posted_at == NOW
    assert r.description == (
        "Systems Developer · Quill Works · Iceland · Full Time · $60 - 72 K · Rust, Linux, Full Time"
    )


def test_single_offer_and_empty_pages(spark, landing):
    one = hf.jobgether(landing(("jobgether", "0", offer_card(7, "Lone Developer")))).collect()
    assert [r.company for r in one] == ["Quill Works"]
    for body in ("", "<div>nothing</div>"):
        assert hf.jobgether(landing(("jobgether", "0", body))).count() == 0
    assert hf.jobgether(landing(("jobgether", "0", offer_card(7, "Lone Developer"))), cap=0).count() == 0


def startup(name, jobs):
    rows = "".join(
        f"""<div class="row"><div><div><a href="/jobs/{i}-x?src=1">{title}</a><span>Full-time</span></div>
        <div><div><span>$100k – $120k</span></div><div><span>Remote only • Oslo</span></div>
        <div><span>4 years of exp</span></div></div><span>3 days ago</span></div></div>"""
        for i, title in jobs
    )
    return f"""<div class="startup"><div><div><div data-testid="startup-header">
      <a href="/company/{name}"><img alt="logo"/></a><div><a href="/company/{name}"><h2>{name}</h2></a>
      <span>Better paperwork for small museums</span><span>11-50 Employees</span></div>
      </div></div></div><div>{rows}</div></div>"""


def test_startup_cards(spark, landing):
    page = startup("Folio", [(41, "Software Engineer"), (42, "Archivist")]) + startup("Verso", [(43, "Tester")])
    rows = hf.wellfound(landing(("wellfound", "0", page))).orderBy("item_ord").collect()
    assert [(r.title, r.company, r.external_id) for r in rows] == [
        ("Software Engineer", "Folio", "41"), ("Archivist", "Folio", "42"), ("Tester", "Verso", "43"),
    ]
    r = rows[0]
    assert r.url == "https://wellfound.com/jobs/41-x"
    assert (r.budget, r.location) == ("$100k – $120k", "Remote only • Oslo")
    assert r.tags == ["Full-time", "4 years of exp"]
    assert r.posted_at == NOW - datetime.timedelta(days=3)
    assert r.description.startswith("Software Engineer · Folio · Better paperwork for small museums · Remote")


@pytest.mark.parametrize(
    "body",
    [
        '<script src="https://x.captcha-delivery.com/i.js"></script>' + startup("A", [(1, "Engineer")]),
        "<title>Just a moment...</title>" + startup("A", [(1, "Engineer")]),
        "",
        '<div data-testid="startup-header"><a href="/company/x"><h2>X</h2></a></div><a href="/jobs/signup">Go</a>',
    ],
)
def test_startup_pages_without_listings(spark, landing, body):
    assert hf.wellfound(landing(("wellfound", "0", body))).count() == 0


def test_alert_mail(spark, landing):
    mail = """<table><tr><td><a href="https://x.test/comm/jobs/view/991?trk=a">Rust Engineer</a><br>
      Quill Works · Remote<p>Easy apply</p></td></tr>
      <tr><td><a href="https://x.test/jobs/view/991">View job</a></td></tr>
      <tr><td><a href="https://x.test/jobs/view/992"><b>Clerk</b> II</a></td></tr></table>"""
    again = '<a href="/jobs/view/991">Another Title</a>'
    rows = hf.linkedin_email(
        landing(("linkedin_email", "0", mail), ("linkedin_email", "1", again))
    ).orderBy("item_ord").collect()
    assert [(r.external_id, r.title, r.company) for r in rows] == [
        ("991", "Rust Engineer", "Quill Works"), ("992", "Clerk II", None),
    ]
    assert rows[0].url == "https://www.linkedin.com/jobs/view/991/"
    assert rows[0].description == "Rust Engineer\nQuill Works · Remote\nEasy apply"


def test_guest_search(spark, landing):
    card = """<li><div class="base-card x"><a class="base-card__full-link" href="https://l.test/jobs/view/dev-5?x=1"></a>
      <h3 class="base-search-card__title"> Dev </h3>
      <h4 class="base-search-card__subtitle"><a>Quill</a></h4>
      <span class="job-search-card__location">Oslo</span><time datetime="2024-01-20">x</time></div></li>"""
    rows = hf.linkedin_web(landing(("linkedin_web", "0", f"<ul>{card}{card}</ul>"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.external_id, r.title, r.company, r.location) == ("dev-5", "Dev", "Quill", "Oslo")
    assert r.posted_at == datetime.datetime(2024, 1, 20)
    assert r.description == "Dev · Quill · Oslo"


def test_article_cards(spark, landing):
    page = """<article><a class="jl-title__link" href="/jobs/job/77"><i class="icon">work</i>PHP Developer</a>
      <span class="jl-company__name"><i class="icon">business</i> Quill</span>
      <span class="jl-salary">PKR 90k</span><span class="jl-chip">Full Time</span>
      <span class="jl-chip">3 Years</span><p class="jl-desc">Build things.</p></article>
      <article><p>no link</p></article>"""
    (r,) = hf.mustakbil(landing(("mustakbil", "0", page))).collect()
    assert (r.title, r.company, r.budget, r.location) == ("PHP Developer", "Quill", "PKR 90k", "Pakistan")
    assert r.description == "Build things. · Full Time · Experience: 3 Years"
    assert r.tags == ["Full Time", "3 Years"]
    assert (r.url, r.external_id) == ("https://www.mustakbil.com/jobs/job/77", "77")


def test_link_lists(spark, landing):
    rozee = """<div class="job"><h3><a href="/acme-senior-dev-jobs-12345?x=1">Senior <b>Laravel</b> Developer</a></h3>
      <div><p>Quill Works</p></div></div>
      <li><a href="//www.rozee.pk/qa-jobs-99999">QA Person</a> <span>Posted today</span> <span>Lahore, PK</span></li>
      <li><a href="/short-jobs-12">Not a listing</a></li><a href="/x-jobs-77777">abc</a>"""
    rows = hf.rozee(landing(("rozee", "0", rozee))).orderBy("item_ord").collect()
    assert [(r.title, r.company, r.location) for r in rows] == [
        ("Senior Laravel Developer", "Quill Works", "Pakistan"), ("QA Person", None, "Lahore, PK"),
    ]
    assert rows[0].url == "https://www.rozee.pk/acme-senior-dev-jobs-12345"

    bayt = """<li><h2><a href="/en/pakistan/jobs/dev-4567/"><b>Developer</b></a></h2><b>Bold Co</b></li>
      <li><h2><a href="/en/pakistan/jobs/ops-4568/">Operator</a></h2><div class="x jb-company">Marked Co</div></li>
      <a href="/en/pakistan/jobs/?page=20000">next page</a>"""
    rows = hf.bayt(landing(("bayt", "0", bayt))).orderBy("item_ord").collect()
    assert [(r.title, r.company) for r in rows] == [("Developer", "Bold Co"), ("Operator", "Marked Co")]


def test_html_text(spark):
    from listwright.functions.html import html_to_text

    cases = {
        "<p>a<br>b &amp; c</p>": "a\nb & c",
        "x<script>var a='<p>';</script><style>p{}</style><!-- no -->y": "x\ny",
        "plain\n\n  text ": "plain\ntext",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want string")
    for r in df.withColumn("got", html_to_text("html")).collect():
        assert r.got == r.want
