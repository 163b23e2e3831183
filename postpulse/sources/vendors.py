"""Vendor documents to the one posting schema: a schema, a path and a projection each.

A raw document is one board's JSON body.  ``from_json`` with the vendor's
schema, ``explode`` of its list and one ``select`` of built-in functions give
posting rows; nothing runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.functions import lexicons as lex
from postpulse.functions import text as t
from postpulse.operators.staging import fresh_folder

POSTING = (
    "source",
    "company",
    "company_url",
    "job_id",
    "title",
    "url",
    "location",
    "workplace",
    "department",
    "team",
    "employment_type",
    "posted_at",
    "updated_at",
    "salary_min",
    "salary_max",
    "salary_currency",
    "seniority",
    "description",
)


@dataclass(frozen=True)
class Vendor:
    """``listing`` is the path of the array ("" if the body is one); ``fields`` maps a job."""

    schema: str
    listing: str
    board_url: str
    fields: Callable[[Column], dict[str, Column]]


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def _place(*parts: Column) -> Column:
    """The non-blank parts, trimmed and joined by commas; the empty string if none."""
    return F.array_join(
        F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""),
        ", ",
    )


def _common(title: Column, body: Column, paid: Column | None = None) -> dict[str, Column]:
    """What every vendor's projection derives from the title and the body alike."""
    pay = t.salary(_text(title, body)) if paid is None else paid
    return {
        "title": F.trim(F.coalesce(title, F.lit(""))),
        "salary_min": pay["salary_min"],
        "salary_max": pay["salary_max"],
        "salary_currency": pay["salary_currency"],
        "seniority": t.seniority(title),
        "description": _blank(body),
    }


def _greenhouse(j: Column) -> dict[str, Column]:
    body = t.strip_html(t.decode_or_raw(F.coalesce(j["content"], F.lit(""))))
    place = F.coalesce(j["location"]["name"], F.lit(""))
    return _common(j["title"], body) | {
        "job_id": j["id"],
        "url": j["absolute_url"],
        "location": _blank(place),
        "workplace": t.workplace(_text(place, j["title"])),
        "department": F.get(j["departments"], F.lit(0))["name"],
        "posted_at": t.timestamp_or_null(F.coalesce(j["first_published"], j["updated_at"])),
        "updated_at": t.timestamp_or_null(j["updated_at"]),
    }


def _ashby(j: Column) -> dict[str, Column]:
    body = t.strip_html(F.coalesce(j["descriptionPlain"], j["descriptionHtml"]))
    place = F.coalesce(j["location"], F.lit(""))
    tier = j["compensation"]["compensationTierSummary"]
    return _common(j["title"], body, t.salary(_text(j["title"], tier, body))) | {
        "job_id": j["id"],
        "url": F.coalesce(j["jobUrl"], j["applyUrl"]),
        "location": _blank(place),
        "workplace": t.workplace(_text(place, j["workplaceType"]), j["workplaceType"]),
        "department": j["department"],
        "team": j["team"],
        "employment_type": j["employmentType"],
        "posted_at": t.timestamp_or_null(j["publishedAt"]),
        "updated_at": t.timestamp_or_null(F.coalesce(j["updatedAt"], j["publishedAt"])),
    }


def _lever(j: Column) -> dict[str, Column]:
    body = t.strip_html(F.coalesce(j["descriptionPlain"], j["description"]))
    place = F.coalesce(j["categories"]["location"], F.lit(""))
    return _common(j["text"], body) | {
        "job_id": j["id"],
        "url": F.coalesce(j["hostedUrl"], j["applyUrl"]),
        "location": _blank(place),
        "workplace": t.workplace(_text(place, j["workplaceType"])),
        "department": j["categories"]["department"],
        "team": j["categories"]["team"],
        "employment_type": j["categories"]["commitment"],
        "posted_at": F.timestamp_millis(j["createdAt"]),
        "updated_at": F.timestamp_millis(F.coalesce(j["updatedAt"], j["createdAt"])),
    }


def _workable(j: Column) -> dict[str, Column]:
    body = t.strip_html(j["description"])
    place = _place(j["city"], j["state"], j["country"])
    label = _text(place, j["title"])
    hybrid = t.ascii_words(label).rlike(f"(?i){lex.HYBRID}")
    stated = F.when(F.coalesce(j["telecommuting"], F.lit(False)) & ~hybrid, "remote")
    return _common(j["title"], body) | {
        "job_id": F.coalesce(j["shortcode"], j["id"]),
        "url": F.coalesce(j["url"], j["shortlink"], j["application_url"]),
        "location": _blank(place),
        "workplace": t.workplace(label, stated),
        "department": _blank(j["department"]),
        "employment_type": j["employment_type"],
        "posted_at": t.timestamp_or_null(F.coalesce(j["published_on"], j["created_at"])),
        "updated_at": t.timestamp_or_null(F.coalesce(j["created_at"], j["published_on"])),
    }


def _breezy(j: Column) -> dict[str, Column]:
    # Only a missing name falls back to the parts; an empty one means no place.
    where = j["location"]
    place = F.coalesce(where["name"], _place(where["city"], where["country"]["name"]))
    pay = t.salary(_text(j["name"], j["salary"]))
    return _common(j["name"], F.lit(""), pay) | {
        "job_id": F.coalesce(j["id"], j["friendly_id"]),
        "url": j["url"],
        "location": _blank(place),
        "workplace": t.workplace(_text(place, j["name"])),
        "department": _blank(j["department"]),
        "employment_type": j["type"]["name"],
        "posted_at": t.timestamp_or_null(j["published_date"]),
        "updated_at": t.timestamp_or_null(j["published_date"]),
    }


def _recruitee(j: Column) -> dict[str, Column]:
    place = F.coalesce(j["location"], _place(j["city"], j["country_code"]))
    return _common(j["title"], t.strip_html(j["description"]), t.period_salary(j["salary"])) | {
        "job_id": F.coalesce(j["id"], j["slug"]),
        "url": j["careers_url"],
        "location": _blank(place),
        "workplace": t.workplace(_text(place, j["title"])),
        "department": _blank(j["department"]),
        "employment_type": _blank(j["employment_type_code"]),
        "posted_at": t.timestamp_or_null(j["published_at"]),
        "updated_at": t.timestamp_or_null(j["published_at"]),
    }


def _teamtailor(j: Column) -> dict[str, Column]:
    ld = j["_jobposting"]
    where = F.get(ld["jobLocation"], F.lit(0))["address"]
    place = _place(where["addressLocality"], where["addressRegion"], where["addressCountry"])
    posted = t.timestamp_or_null(F.coalesce(j["date_published"], ld["datePosted"]))
    return _common(j["title"], t.strip_html(j["content_html"])) | {
        "job_id": j["id"],
        "url": j["url"],
        "location": _blank(place),
        "workplace": t.workplace(_text(place, j["title"])),
        "department": _blank(ld["department"]),
        "employment_type": _blank(ld["employmentType"]),
        "posted_at": posted,
        "updated_at": posted,
    }


VENDORS = {
    "greenhouse": Vendor(
        "id string, title string, absolute_url string, location struct<name:string>, "
        "departments array<struct<name:string>>, first_published string, updated_at string, content string",
        "jobs",
        "https://job-boards.greenhouse.io/{}",
        _greenhouse,
    ),
    "ashby": Vendor(
        "id string, title string, jobUrl string, applyUrl string, location string, workplaceType string, "
        "department string, team string, employmentType string, publishedAt string, updatedAt string, "
        "descriptionPlain string, descriptionHtml string, compensation struct<compensationTierSummary:string>",
        "jobs",
        "https://jobs.ashbyhq.com/{}",
        _ashby,
    ),
    "lever": Vendor(
        "id string, text string, hostedUrl string, applyUrl string, workplaceType string, createdAt bigint, "
        "updatedAt bigint, descriptionPlain string, description string, "
        "categories struct<location:string,department:string,team:string,commitment:string>",
        "",
        "https://jobs.lever.co/{}",
        _lever,
    ),
    "workable": Vendor(
        "id string, shortcode string, title string, employment_type string, telecommuting boolean, "
        "department string, url string, shortlink string, application_url string, published_on string, "
        "created_at string, country string, city string, state string, description string",
        "jobs",
        "https://apply.workable.com/{}/",
        _workable,
    ),
    "breezy": Vendor(
        "id string, friendly_id string, name string, url string, published_date string, "
        "type struct<name:string>, department string, salary string, "
        "location struct<name:string,city:string,country:struct<name:string>>",
        "",
        "https://{}.breezy.hr/",
        _breezy,
    ),
    "recruitee": Vendor(
        "id string, slug string, title string, department string, published_at string, "
        "employment_type_code string, location string, city string, country_code string, careers_url string, "
        "description string, salary struct<min:string,max:string,period:string,currency:string>",
        "offers",
        "https://{}.recruitee.com/",
        _recruitee,
    ),
    "teamtailor": Vendor(
        "id string, title string, url string, date_published string, content_html string, "
        "_jobposting struct<datePosted:string,employmentType:string,department:string,"
        "jobLocation:array<struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>>>",
        "items",
        "https://{}.teamtailor.com/",
        _teamtailor,
    ),
}


def jobs(bodies: DataFrame, vendor: Vendor) -> DataFrame:
    """``bodies`` (company, body) with one row for each job; bodies of another shape give none."""
    array = f"array<struct<{_struct(vendor.schema)}>>"
    if vendor.listing:
        parsed = F.from_json("body", f"{vendor.listing} {array}")[vendor.listing]
    else:
        # A lone object would be read as an array of one.
        listed = F.ltrim("body").startswith("[")
        parsed = F.when(listed, F.from_json("body", array))
    return bodies.select("company", F.explode(parsed).alias("job"))


def _struct(schema: str) -> str:
    """``name type`` fields as a struct's ``name:type``."""
    fields, depth, part = [], 0, ""
    for char in schema + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            part = ""
        else:
            part += char
    return ",".join(fields)


#: The fields that the public feed leaves out.
FEED_DROPS = ("company_url", "description")


def normalise(bodies: DataFrame, name: str, feed: bool = False) -> DataFrame:
    """Posting rows of one vendor's boards, in the schema ``POSTING``.

    The feed's form has no ``FEED_DROPS`` and takes the publication date as the
    last change where the vendor's form would prefer another one (ashby).
    """
    vendor = VENDORS[name]
    before, after = vendor.board_url.split("{}")
    fields = {
        "source": F.lit(name),
        "company": F.col("company"),
        "company_url": F.concat(F.lit(before), F.col("company"), F.lit(after)),
        **vendor.fields(F.col("job")),
    }
    if feed and name == "ashby":
        fields["updated_at"] = fields["posted_at"]
    kinds = {"posted_at": "timestamp", "updated_at": "timestamp"}
    kinds |= {"salary_min": "bigint", "salary_max": "bigint"}
    return jobs(bodies, vendor).select(
        *[
            fields.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c)
            for c in POSTING
            if not (feed and c in FEED_DROPS)
        ]
    )


def all_postings(
    bodies: DataFrame, vendors: tuple[str, ...] = (), feed: bool = False
) -> DataFrame:
    """Postings of the named vendors (none named: all); ``bodies`` has source, company and body.

    Each branch filters on the source, so a table partitioned by it is read
    once in all; ``by_source`` makes one of bodies that are still to be computed.
    """
    names = vendors or tuple(VENDORS)
    parts = [normalise(bodies.where(F.col("source") == n), n, feed) for n in names]
    return reduce(DataFrame.unionByName, parts)


def board_url(source: Column, company: Column) -> Column:
    """The public address of a board; null for unknown sources and boards without a name."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, vendor in VENDORS.items():
        before, after = vendor.board_url.split("{}")
        found = found.when(source == name, F.concat(F.lit(before), t.quoted(company), F.lit(after)))
    return F.when(F.coalesce(company, F.lit("")) != "", found)


def by_source(bodies: DataFrame) -> DataFrame:
    """``bodies`` written down once, a folder for each source, in the shared folder."""
    path = fresh_folder(bodies.sparkSession, "bodies")
    bodies.write.partitionBy("source").parquet(path)
    found = bodies.sparkSession.read.schema(bodies.schema).parquet(path)
    return found.select(*bodies.columns)


def unexpected_shapes(bodies: DataFrame, name: str) -> DataFrame:
    """Boards whose body has no array where the vendor puts its jobs."""
    vendor = VENDORS[name]
    path = f"$.{vendor.listing}" if vendor.listing else "$"
    value = F.trim(F.get_json_object("body", path))
    return bodies.where(~F.coalesce(value.startswith("["), F.lit(False))).select("company")
