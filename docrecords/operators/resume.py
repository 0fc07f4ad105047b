"""Résumé structuring: sections, candidate name, contact details and row assembly.

The reading order of a résumé decides what belongs together.  All of it is expressed as windows
over the blocks of a document (one shuffle by document, shared by every window): a running count
of openings gives the group, carried values come from `last(..., ignorenulls)`.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import humanize_label, trim_ws
from . import canonical, structure

# Section titles (normalized to lower-case words).
SECTION_TITLES = {
    "summary": (
        "summary", "profile", "objective", "about", "professional summary", "career summary",
        "executive summary", "personal statement",
    ),
    "experience": (
        "work experience", "professional experience", "experience", "employment",
        "employment history", "career history", "work history", "professional background",
        "relevant experience", "related experience", "volunteer experience",
    ),
    "education": ("education", "academic background", "academics", "training", "qualifications"),
    "skills": (
        "skills", "technical skills", "core skills", "competencies", "technologies",
        "areas of expertise",
    ),
    "projects": ("projects", "project", "selected projects", "portfolio"),
    "achievements": (
        "achievements", "achievement", "awards", "awards and certificates",
        "awards and certifications", "certifications", "certification", "accomplishments", "honors",
        "honours",
    ),
}
STRONG_SECTIONS = ("experience", "education", "skills", "projects")
NOT_EXPERIENCE = (
    r"^(?:years|months|number|level|area|areas|field|fields) of experience\z"
    r"|^(?:extensive|significant|demonstrated|proven|hands on) experience\z"
)
SOME_EXPERIENCE = r"^[a-z0-9][a-z0-9 ]{0,42} experience\z"
TEMPLATE_WORDS = "sample|example|template|format|functional|chronological|combination"
PROSE_VERBS = (
    "built|led|designed|implemented|providing|provided|developing|developed|created|maintained|"
    "worked|collaborated|optimized|improved|delivered|owned|managed|spearheaded|architected|"
    "automated|enhanced|reduced|increased|established|contributed|responsible|utilized|used|helped|"
    "supported|partnered"
)
ROLE_WORDS = (
    "SDE|SRE|VP|Intern|Analyst|Associate|Engineer|Developer|Manager|Architect|Consultant|Lead|"
    "Specialist|Designer"
)
ORGANIZATION_WORDS = (
    "inc|llc|ltd|limited|corp|corporation|company|technologies|technology|systems|solutions|labs|"
    "studio|group|bank|stanley|harness"
)
AWARD_WORDS = (
    "award|recognition|certificate|certification|scholarship|honou?r|prize|fellowship|showcase|"
    "hackathon"
)
AWARD_VERBS = "recipient|won|received|achieved|secured|completed|recognized"
LINKING_WORDS = (
    "for|and|across|with|to|in|on|from|by|at|via|within|including|reducing|improving|solving|"
    "designing|building"
)
BULLET = f"^[-*•]{V.WS}"
BULLET_MARK = f"^[-*•]{V.WS}*"
NAME_WORD = r"^(?:[A-Z][A-Za-z.'-]*)\z"
TEXT_KINDS = ("paragraph", "line", "list-item", "kv")


def _whole(words: str) -> str:
    return f"(?i){V.B_LEFT}(?:{words}){V.B_RIGHT}"


def _opening(words: str) -> str:
    return f"(?i)^(?:{words}){V.B_RIGHT}"


def normalize_heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _word_count(text: Column) -> Column:
    return F.size(F.split(text, V.WS + "+"))


def section_kind(text: Column) -> Column:
    """Kind of a résumé section title, null for other text."""
    h = normalize_heading(text)
    experience = h.isin(*SECTION_TITLES["experience"]) | (
        h.rlike(SOME_EXPERIENCE) & ~h.rlike(NOT_EXPERIENCE) & (_word_count(h) <= 5)
    )
    return (
        F.when(h.isin(*SECTION_TITLES["summary"]), "summary")
        .when(experience, "experience")
        .when(h.isin(*SECTION_TITLES["education"]), "education")
        .when(h.isin(*SECTION_TITLES["skills"]), "skills")
        .when(h.isin(*SECTION_TITLES["projects"]), "projects")
        .when(h.isin(*SECTION_TITLES["achievements"]), "achievements")
    )


def strip_period(raw: Column) -> tuple[Column, Column]:
    """(text without its date range, the date range or null)."""
    period = F.regexp_substr(raw, F.lit(V.DATE_RANGE))
    # Only the first occurrence is taken out.
    at = F.instr(raw, period)
    rest = F.concat(F.left(raw, at - 1), F.substr(raw, at + F.length(period)))
    rest = trim_ws(F.regexp_replace(rest, V.WS + "{2,}", " "))
    return F.when(period.isNull(), trim_ws(raw)).otherwise(rest), trim_ws(period)


def is_bullet_or_prose(text: Column) -> Column:
    return text.rlike(BULLET) | text.rlike(_opening(PROSE_VERBS))


def is_role_line(text: Column) -> Column:
    """A job title line: it ends in a period of time or carries a role word."""
    ends_in_period = text.rlike(V.DATE_RANGE + r".{0,2}\z")
    starts_like_title = text.rlike(
        f"(?i)^[A-Z0-9][A-Za-z0-9{V.WS_CHARS}.\\-/&,]*{V.B_LEFT}(?:{ROLE_WORDS}){V.B_RIGHT}"
    )
    return (
        F.length(text).between(1, 120)
        & ~is_bullet_or_prose(text)
        & (ends_in_period | ((F.length(text) <= 80) & starts_like_title))
    )


def _may_be_organization(text: Column) -> Column:
    return (
        F.length(text).between(1, 96)
        & ~is_role_line(text)
        & ~is_bullet_or_prose(text)
        & section_kind(text).isNull()
        & ~text.rlike("[/:]")
    )


def has_organization_cue(text: Column) -> Column:
    cue = text.contains(",") | text.rlike(_whole(ORGANIZATION_WORDS))
    return _may_be_organization(text) & cue


def is_plain_organization(text: Column) -> Column:
    """Up to four capitalized words: an organization only where none came before."""
    words = F.split(text, V.WS + "+")
    plain = (F.size(words) <= 4) & F.forall(words, lambda w: w.rlike(r"^[A-Z0-9][A-Za-z0-9&.'-]*\z"))
    return _may_be_organization(text) & plain


def is_project_label(text: Column) -> Column:
    """A short capitalized heading inside experience that names a project, not an employer."""
    words = F.split(text, V.WS + "+")
    return (
        F.length(text).between(1, 48)
        & ~text.rlike(V.DATE_RANGE)
        & ~is_role_line(text)
        & ~has_organization_cue(text)
        & section_kind(text).isNull()
        & (F.size(words) <= 3)
        & F.forall(words, lambda w: w.rlike(r"^[A-Z0-9][A-Za-z0-9+.#/&-]*\z"))
    )


# --- sections ------------------------------------------------------------------------------


def _doc_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("block_no")


def resume_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with their section: kind, number (adjacent sections of one kind are merged), title.

    `section_kind` is null in the preamble; `is_title` marks section titles.
    """
    kind = F.when(F.col("kind").isin("heading", "paragraph", "line"), section_kind(F.col("text")))
    order = _doc_order()
    rows = blocks.withColumn("_title", kind)
    previous = F.last("_title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns(
        {
            "_opens": F.col("_title").isNotNull() & (F.coalesce(previous, F.lit("")) != F.col("_title")),
            "section_kind": F.last("_title", ignorenulls=True).over(order),
            "is_title": F.col("_title").isNotNull(),
        }
    )
    return rows.withColumn(
        "section_index", F.sum(F.col("_opens").cast("int")).over(order)
    ).drop("_title", "_opens")


def resume_documents(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents that are résumés: two strong sections, or one and an e-mail address."""
    strong = F.when(F.col("is_title") & F.col("section_kind").isin(*STRONG_SECTIONS), F.col("section_kind"))
    counts = sections.groupBy("doc_id").agg(F.count_distinct(strong).alias("n"))
    # Few documents have a strong section; the address is looked up only in those.
    likely = counts.filter(F.col("n") >= 1)
    return (
        likely.join(texts.select("doc_id", "text"), "doc_id")
        .filter((F.col("n") >= 2) | F.col("text").rlike(V.EMAIL))
        .select("doc_id")
    )


def _is_template_title(text: Column) -> Column:
    h = normalize_heading(text)
    words = _word_count(h)
    last = F.substring_index(h, " ", -1)
    return (
        (h.rlike(f"{V.B_LEFT}(?:curriculum vitae|cv){V.B_RIGHT}") & (words <= 5))
        | (h.rlike(f"{V.B_LEFT}resume{V.B_RIGHT}") & h.rlike(f"{V.B_LEFT}(?:{TEMPLATE_WORDS}){V.B_RIGHT}"))
        | (last.isin("resume", "cv") & (words >= 2))
    )


def looks_like_name(text: Column) -> Column:
    words = F.split(text, V.WS + "+")
    return (
        F.length(text).between(3, 60)
        & ~_is_template_title(text)
        & ~text.rlike(r"@|https?:|www\.|\d")
        & section_kind(text).isNull()
        & F.size(words).between(2, 5)
        & F.forall(words, lambda w: w.rlike(NAME_WORD))
    )


def candidate_name(sections: DataFrame) -> DataFrame:
    """Candidate name per document: the nearest name-like line at most five blocks above the first
    contact line, else on that line, else the first name-like line of the preamble."""
    t = trim_ws(F.col("text"))
    parts = F.filter(F.transform(F.split(t, "[|,;]"), trim_ws), lambda p: p != "")
    name = F.coalesce(F.get(F.filter(parts, looks_like_name), F.lit(0)), F.when(looks_like_name(t), t))
    preamble = sections.filter(F.col("section_kind").isNull()).withColumn(
        "_nth", F.row_number().over(_doc_order())
    )
    contact = F.col("text").rlike(V.EMAIL) | F.col("text").rlike(V.PHONE)
    rows = preamble.withColumns({"_name": name, "_contact": F.when(contact, F.col("_nth"))})
    rows = rows.withColumn("_at", F.min("_contact").over(Window.partitionBy("doc_id")))
    distance = F.col("_at") - F.col("_nth")
    near = distance.between(1, 5)
    allowed = F.col("kind").isin("heading", "line", "paragraph")
    rank = (
        F.when(near, distance)
        .when(distance == 0, 10)
        .when(allowed, F.col("_nth") + 100)
    )
    return (
        rows.filter(F.col("_name").isNotNull() & rank.isNotNull())
        .groupBy("doc_id")
        .agg(F.min_by(F.struct(F.col("_name").alias("value"), "start", "end"), rank).alias("n"))
        .select("doc_id", "n.*")
    )


# --- rows ----------------------------------------------------------------------------------

ROW_COLUMNS = ("doc_id", "array_key", "row_index", "column_key", "value", "start", "end")


def _cells(rows: DataFrame, array_key: str, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long cells of wide rows: {column: (value, span)}; empty values give no cell."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("column_key"), trim_ws(v).alias("value"), s["start"].alias("start"), s["end"].alias("end"))
            for n, (v, s) in columns.items()
        ]
    )
    return (
        rows.select("doc_id", "row_index", F.explode(cells).alias("c"))
        .filter(F.col("c.value") != "")
        .select("doc_id", F.lit(array_key).alias("array_key"), F.col("row_index").cast("int"), "c.*")
        .select(*ROW_COLUMNS)
    )


def _block() -> Column:
    return F.struct("block_no", trim_ws(F.col("text")).alias("text"), "start", "end")


def _ordered(condition: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(condition, _block())))


def _span(blocks: Column) -> Column:
    first, last = F.get(blocks, F.lit(0)), F.get(F.reverse(blocks), F.lit(0))
    return F.struct(first["start"].alias("start"), last["end"].alias("end"))


def _joined(blocks: Column, sep: str = "\n", bullets: bool = False) -> Column:
    texts = F.transform(blocks, lambda b: F.regexp_replace(b["text"], BULLET_MARK, "") if bullets else b["text"])
    return F.array_join(F.filter(texts, lambda t: t != ""), sep)


def _or(blocks: Column, other: Column) -> Column:
    return F.when(F.size(blocks) > 0, blocks).otherwise(other)


def _body(sections: DataFrame, kind: str) -> DataFrame:
    return sections.filter((F.col("section_kind") == kind) & ~F.col("is_title"))


def _row_numbers(rows: DataFrame, *order: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return rows.withColumn("row_index", number)


def summary_rows(sections: DataFrame) -> DataFrame:
    """The summary text of a document (key `summary`, no row)."""
    grouped = _body(sections, "summary").groupBy("doc_id", "section_index").agg(
        _ordered(F.col("kind") != "heading").alias("body"), _ordered(F.lit(True)).alias("every")
    )
    first = grouped.groupBy("doc_id").agg(F.min_by(F.struct("body", "every"), "section_index").alias("g"))
    return first.select(
        "doc_id",
        _joined(F.col("g.body")).alias("value"),
        _span(F.col("g.every"))["start"].alias("start"),
        _span(F.col("g.every"))["end"].alias("end"),
    ).filter(F.col("value") != "")


def skills_rows(sections: DataFrame, key_values: DataFrame) -> DataFrame:
    """One row per labelled value in the skills section, or one row with its plain text."""
    area = sections.filter(F.col("section_kind") == "skills")
    pairs = key_values.join(
        area.filter(F.col("kind") == "kv").select("doc_id", F.col("block_no").alias("line_no"), "section_index"),
        ["doc_id", "line_no"],
    ).select("doc_id", "section_index", F.struct("line_no", "pair_no").alias("at"), "key", "value", "start", "end")
    plain = (
        area.groupBy("doc_id", "section_index")
        .agg(
            _ordered(~F.col("is_title") & (F.col("kind") != "heading")).alias("body"),
            _ordered(~F.col("is_title")).alias("every"),
            F.bool_or(F.col("kind") == "kv").alias("labelled"),
        )
        .filter(~F.col("labelled"))
        .select(
            "doc_id",
            "section_index",
            F.struct(F.lit(0).alias("line_no"), F.lit(0).alias("pair_no")).alias("at"),
            F.lit("Skills").alias("key"),
            _joined(F.col("body")).alias("value"),
            _span(F.col("every"))["start"].alias("start"),
            _span(F.col("every"))["end"].alias("end"),
        )
        .filter(F.col("value") != "")
    )
    rows = _row_numbers(pairs.unionByName(plain), "section_index", "at")
    span = F.struct("start", "end")
    return _cells(
        rows, "skills", {"category": (humanize_label(F.col("key")), span), "text": (F.col("value"), span)}
    )


def _chunks(body: DataFrame) -> DataFrame:
    """Blocks of a section cut at its headings; `_chunk` numbers the pieces."""
    useful = body.filter(F.col("kind").isin("heading", *TEXT_KINDS))
    opens = (F.col("kind") == "heading").cast("int")
    return useful.withColumn("_chunk", F.sum(opens).over(Window.partitionBy("doc_id", "section_index").orderBy("block_no")))


def education_rows(sections: DataFrame) -> DataFrame:
    """Institution, credential and period; a bare heading without dates belongs to the row above."""
    pieces = Window.partitionBy("doc_id", "section_index", "_chunk")
    rows = _chunks(_body(sections, "education"))
    heading = F.col("kind") == "heading"
    rows = rows.withColumn("_bodies", F.count_if(~heading).over(pieces))
    starts = Window.partitionBy("doc_id", "section_index").orderBy("block_no")
    bare = heading & (F.col("_bodies") == 0) & ~F.col("text").rlike(V.DATE_RANGE)
    first = F.row_number().over(starts) == 1
    opens = first | (heading & ~bare)
    rows = rows.withColumn("_opens", opens).withColumn("_row", F.sum(F.col("_opens").cast("int")).over(starts))
    grouped = rows.groupBy("doc_id", "section_index", "_row").agg(
        _ordered(heading & F.col("_opens")).alias("head"),
        _ordered(~(heading & F.col("_opens"))).alias("body"),
        _ordered(F.lit(True)).alias("every"),
    )
    grouped = _row_numbers(grouped, "section_index", "_row")
    titled = F.size("head") > 0
    lead = F.get("every", F.lit(0))["text"]
    rest = F.when(titled, F.col("body")).otherwise(F.slice("body", F.lit(2), F.greatest(F.size("body") - 1, F.lit(0))))
    grouped = grouped.withColumns({"_rest": rest, "_lead": lead})
    grouped = grouped.withColumn("_credential", _joined(F.col("_rest")))
    institution, p1 = strip_period(F.col("_lead"))
    credential, p2 = strip_period(F.col("_credential"))
    _, p3 = strip_period(_joined(F.col("every")))
    return _cells(
        grouped,
        "education",
        {
            "institution": (institution, _span(F.when(titled, F.col("head")).otherwise(_or(F.slice("_rest", 1, 1), F.col("every"))))),
            "credential": (credential, _span(_or(F.col("_rest"), F.col("every")))),
            "period": (F.coalesce(p2, p1, p3), _span(F.col("every"))),
        },
    )


def project_rows(sections: DataFrame) -> DataFrame:
    heading = F.col("kind") == "heading"
    grouped = _chunks(_body(sections, "projects")).groupBy("doc_id", "section_index", "_chunk").agg(
        _ordered(heading).alias("head"), _ordered(~heading).alias("body")
    )
    grouped = grouped.withColumns(
        {
            "_name": F.coalesce(F.get("head", F.lit(0))["text"], F.lit("")),
            "_text": _joined(F.col("body"), bullets=True),
        }
    ).filter((F.col("_name") != "") | (F.col("_text") != ""))
    text = F.when(F.col("_text") != "", F.col("_text")).otherwise(F.col("_name"))
    return _cells(
        _row_numbers(grouped, "section_index", "_chunk"),
        "projects",
        {
            "name": (F.col("_name"), _span(_or(F.col("head"), F.slice("body", 1, 1)))),
            "description": (text, _span(_or(F.col("body"), F.col("head")))),
        },
    )


def achievement_rows(sections: DataFrame) -> DataFrame:
    """Awards; lines that continue the one before are joined to it."""
    body = _body(sections, "achievements").filter(F.col("kind").isin("heading", *TEXT_KINDS))
    order = Window.partitionBy("doc_id", "section_index").orderBy("block_no")
    text = trim_ws(F.col("text"))
    rows = body.filter(text != "").withColumn("_text", text).withColumn("_before", F.lag("_text").over(order))
    clean = trim_ws(F.regexp_replace("_text", BULLET_MARK, ""))
    bullet = F.col("_text").rlike(BULLET)
    finished = F.col("_before").rlike(r"[.!?]" + V.WS + r"*\z")
    award = clean.rlike(_whole(AWARD_WORDS))
    lead = clean.rlike(_opening(AWARD_VERBS)) | (award & (F.length(clean) >= 20))
    follows = (
        clean.rlike(r"^[\d(]")
        | clean.rlike(_opening(LINKING_WORDS))
        | clean.rlike("^[a-z]")
        | ((F.length(clean) < 72) & ~award)
        | (~finished & (F.length(clean) < 100) & ~lead)
    )
    joins = (
        F.col("_before").isNotNull()
        & (F.col("kind") != "list-item")
        & ~bullet
        & (clean != "")
        & ~(lead & ~finished)
        & follows
    )
    rows = rows.withColumn("_row", F.sum((~joins).cast("int")).over(order))
    grouped = rows.groupBy("doc_id", "section_index", "_row").agg(_ordered(F.lit(True)).alias("every"))
    value = F.regexp_replace(_joined(F.col("every"), " ", bullets=True), V.WS + "{2,}", " ")
    grouped = grouped.withColumn("_value", trim_ws(value)).filter(F.col("_value") != "")
    return _cells(
        _row_numbers(grouped, "section_index", "_row"),
        "achievements",
        {"text": (F.col("_value"), _span(F.col("every")))},
    )


def experience_rows(sections: DataFrame) -> DataFrame:
    """Organization, role, period and description per position.

    Header blocks open an entry where body text came before; entries without a role line lend
    their text to the next position of the section (or to the last row, at the end); an
    organization holds until the next one is named.
    """
    in_section = Window.partitionBy("doc_id", "section_index")
    order = in_section.orderBy("block_no")
    t = trim_ws(F.col("text"))
    heading = F.col("kind") == "heading"
    body = _body(sections, "experience").withColumn("_text", t)
    x = F.col("_text")
    role = is_role_line(x) & ~(heading & is_project_label(x))
    body = body.withColumn("_role", role).filter(
        F.col("kind").isin("heading", *TEXT_KINDS) | F.col("_role")
    )
    opening = F.row_number().over(order) == 1
    organization_first = opening & F.col("kind").isin(*TEXT_KINDS) & (
        has_organization_cue(x) | is_plain_organization(x)
    )
    header = (heading & ~is_project_label(x)) | F.col("_role") | organization_first
    rows = body.withColumn("_header", header)
    after_body = ~F.coalesce(F.lag("_header").over(order), F.lit(True))
    rows = rows.withColumn("_starts", F.col("_header") & after_body)
    rows = rows.withColumn("_entry", F.sum(F.col("_starts").cast("int")).over(order))

    entries = rows.groupBy("doc_id", "section_index", "_entry").agg(
        _ordered(F.col("_header")).alias("heads"),
        _ordered(~F.col("_header")).alias("body"),
        F.max(F.when(F.col("_header") & F.col("_role"), F.col("block_no"))).alias("_role_at"),
    )
    head = F.get("heads", F.lit(0))
    entries = entries.withColumns(
        {
            "_role_head": F.get(F.filter("heads", lambda b: b["block_no"] == F.col("_role_at")), F.lit(0)),
            "_first": F.when(F.col("_role_at") > head["block_no"], head["text"]),
        }
    )
    by_entry = in_section.orderBy("_entry")
    so_far = by_entry.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.col("_first").isNotNull()
    strong = named & has_organization_cue(F.col("_first"))
    weak = named & is_plain_organization(F.col("_first"))
    entries = entries.withColumns({"_strong": strong, "_any": strong | weak})
    first_named = F.min(F.when(F.col("_any"), F.col("_entry"))).over(in_section)
    entries = entries.withColumn(
        "_explicit", F.when(F.col("_strong") | (F.col("_any") & (F.col("_entry") == first_named)), F.col("_first"))
    )
    entries = entries.withColumns(
        {
            "_organization": F.coalesce(F.last("_explicit", ignorenulls=True).over(so_far), F.lit("")),
            # Entries without a role belong to the next one with a role.
            "_roles_before": F.coalesce(
                F.sum(F.col("_role_at").isNotNull().cast("int")).over(by_entry.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
            "_roles": F.count("_role_at").over(in_section),
        }
    )
    kept_heads = F.filter(
        "heads",
        lambda b: (b["block_no"] != F.coalesce("_role_at", F.lit(-1)))
        & ~(F.col("_explicit").isNotNull() & (b["block_no"] == head["block_no"])),
    )
    entries = entries.withColumn("_described", F.concat(kept_heads, F.col("body")))
    # Left-over entries at the end of a section fall to its last position, if it has one.
    position = F.least(F.col("_roles_before"), F.greatest(F.col("_roles") - 1, F.lit(0)))
    is_tail = (F.col("_roles") > 0) & (F.col("_roles_before") >= F.col("_roles"))
    grouped = (
        entries.withColumns({"_position": position, "_tail": is_tail})
        .groupBy("doc_id", "section_index", "_position")
        .agg(
            F.max(F.when(F.col("_role_at").isNotNull(), F.struct("_role_head", "_organization", "_explicit", head.alias("_head")))).alias("r"),
            F.flatten(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_tail"), F.struct("_entry", "_described")))), lambda e: e["_described"])).alias("described"),
            F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("_tail"), F.struct("_entry", "_described")))), lambda e: e["_described"])).alias("tail"),
        )
    )
    grouped = grouped.withColumn("_main", _joined(F.col("described"), bullets=True))
    # A tail extends a description that exists; it never starts one below a role.
    tail = F.when((F.col("_main") != "") & (F.size("tail") > 0), _joined(F.col("tail"), bullets=True))
    grouped = grouped.withColumn("_text", F.concat_ws("\n", F.when(F.col("_main") != "", F.col("_main")), tail))
    grouped = grouped.filter(F.col("r").isNotNull() | (F.col("_text") != ""))
    title, period = strip_period(F.col("r._role_head.text"))
    title = F.when(title == "", F.col("r._role_head.text")).otherwise(title)
    role_span = F.struct(F.col("r._role_head.start").alias("start"), F.col("r._role_head.end").alias("end"))
    org_span = F.when(
        F.col("r._explicit").isNotNull(), F.struct(F.col("r._head.start").alias("start"), F.col("r._head.end").alias("end"))
    ).otherwise(role_span)
    text_span = F.when(tail.isNotNull(), _span(F.col("tail"))).when(F.size("described") > 0, _span(F.col("described"))).otherwise(role_span)
    return _cells(
        _row_numbers(grouped, "section_index", "_position"),
        "experience",
        {
            "organization": (F.col("r._organization"), org_span),
            "role": (title, role_span),
            "period": (period, role_span),
            "description": (F.col("_text"), text_span),
        },
    )


def resume_rows(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """All résumé values of the documents that are résumés, as long cells.

    Top-level values have no array key.
    """
    every = resume_sections(canonical.blocks(lines))
    chosen = resume_documents(every, texts)
    sections = every.join(chosen, "doc_id", "left_semi")
    kv = canonical.key_values(lines).join(chosen, "doc_id", "left_semi")
    contacts = structure.extract_contacts(texts.join(chosen, "doc_id", "left_semi"))

    def top(df: DataFrame, key: Column) -> DataFrame:
        return df.select(
            "doc_id",
            F.lit(None).cast("string").alias("array_key"),
            F.lit(None).cast("int").alias("row_index"),
            key.alias("column_key"),
            "value",
            "start",
            "end",
        )

    parts = [
        top(candidate_name(sections), F.lit("candidateName")),
        top(contacts, F.col("key")),
        top(summary_rows(sections), F.lit("summary")),
        skills_rows(sections, kv),
        experience_rows(sections),
        education_rows(sections),
        project_rows(sections),
        achievement_rows(sections),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
