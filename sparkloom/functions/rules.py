"""Rules on single values, as column expressions: keys, labels, formats, checks, boxes, intents. Null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_search_key(query: Column) -> Column:
    """Two queries with one key are one search: case, punctuation and spacing don't count."""
    return F.trim(F.regexp_replace(F.lower(query), "[^a-z0-9]+", " "))


def slug(name: Column, most: int = 20) -> Column:
    """Lower-case letters and digits joined by _, at most so many; "server" if nothing is left."""
    short = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)
    short = F.regexp_replace(short, "_+$", "")
    return F.when(short == "", "server").otherwise(short)


def tool_name(server: Column, tool: Column) -> Column:
    return F.substring(F.concat(F.lit("mcp_"), slug(server), F.lit("_"), F.regexp_replace(tool, "[^A-Za-z0-9_-]", "_")), 1, 64)


def short_model_name(model: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(model, "/", -1)


def neutralise_fence(text: Column, fence: Column) -> Column:
    """Without the fence's id, and no run of three angle brackets."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, fence, F.lit("")), "<{3,}", "<<"), ">{3,}", ">>")


def duration(ms: Column) -> Column:
    """A duration in words: ms, seconds (with a decimal below ten), or minutes and seconds; a dash for null."""
    seconds = ms / 1000
    return (
        F.when(ms.isNull(), "–")
        .when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit(" ms")))
        .when(ms < 10_000, F.concat(F.format_string("%.1f", F.round(seconds, 1)), F.lit(" s")))
        .when(ms < 60_000, F.concat(F.round(seconds).cast("long").cast("string"), F.lit(" s")))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit(" m "), F.round((ms % 60_000) / 1000).cast("long").cast("string"), F.lit(" s")))
    )


def usd(amount: Column) -> Column:
    """Dollars with cents; a dash for null, no decimals for zero. Amounts below a dollar keep two figures, to a millionth at least."""
    places = F.greatest(F.lit(2), F.least(F.lit(7), 1 - F.floor(F.log10(amount)))).cast("int")
    rounded = F.round(amount * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)
    small = F.concat(F.lit("$"), F.substring(F.format_string("%.7f", rounded), F.lit(1), places + 2))
    return F.when(amount.isNull(), "–").when(amount == 0, "$0").when(amount < 1, small).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", amount)))


def indexed_text(heading: Column, caption: Column, content: Column) -> Column:
    """What the text index reads: nulls leave no gap."""
    return F.concat_ws(" ", heading, caption, content)


def passage(title: Column, page: Column, content: Column) -> Column:
    """A passage as a reranker reads it."""
    return F.format_string("%s, page %d:\n%s", title, page, content)


def snippet(text: Column, terms: list[str], width: int = 160) -> Column:
    """About width characters around the first hit of any term, at word borders, with marks where text is left out. terms are lower case."""
    found = [F.locate(t, F.lower(text)) for t in terms]
    at = F.least(*(F.when(x > 0, x - 1) for x in found)) if len(found) > 1 else F.when(found[0] > 0, found[0] - 1)
    head = F.when(F.length(text) > width, F.concat(F.rtrim(F.substring(text, 1, width)), F.lit("…"))).otherwise(text)
    before = F.substring(text, F.lit(1), F.floor(at - F.lit(width / 3)).cast("int") + 1)
    start = F.length(before) - F.length(F.substring_index(before, " ", -1))
    body = F.rtrim(F.substring(text, start + 1, F.lit(width)))
    around = F.concat(F.lit("…"), body, F.when(start + width < F.length(text), "…").otherwise(""))
    return F.when(at.isNull() | (at < width / 2), head).otherwise(around)


def text_key(text: Column) -> Column:
    """Equal for texts that differ in case, spacing and markup only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[*_#`<>\\]", ""), r"\s+", " "))


def repaired_table(text: Column) -> Column:
    """A tabular that was cut off is closed; a closer that was cut off goes first."""
    trimmed = F.regexp_replace(text, r"\s+$", "")
    cut = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)\\end\{[a-z]*$", ""), r"\s+$", "")
    done = ~F.contains(trimmed, F.lit("\\begin{tabular}")) | trimmed.rlike(r"\\end\{tabular\}$")
    return F.when(done, trimmed).otherwise(F.concat(cut, F.lit("\n\\end{tabular}")))


def truncated_table(text: Column) -> Column:
    return F.contains(text, F.lit("\\begin{tabular}")) & ~text.rlike(r"\\end\{tabular\}\s*$")


# boxes: structs of xmin, ymin, xmax, ymax in shares of the page


def usable(box: Column, slack: float = 0.02) -> Column:
    """The right way round, with an area, on the page but for a little slack; false for null or non-finite sides."""
    sides = [box[k] for k in ("xmin", "ymin", "xmax", "ymax")]
    finite = ~F.greatest(*(F.isnan(x).cast("int") for x in sides)).cast("boolean") & F.greatest(*(F.abs(x) for x in sides)).between(0, 1e300)
    inside = (box["xmin"] >= -slack) & (box["ymin"] >= -slack) & (box["xmax"] <= 1 + slack) & (box["ymax"] <= 1 + slack)
    return F.coalesce(finite & (box["xmin"] < box["xmax"]) & (box["ymin"] < box["ymax"]) & inside, F.lit(False))


def union(a: Column, b: Column) -> Column:
    low = [F.least(a[k], b[k]).alias(k) for k in ("xmin", "ymin")]
    return F.struct(*low, *(F.greatest(a[k], b[k]).alias(k) for k in ("xmax", "ymax")))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["xmax"] - box["xmin"]) * F.greatest(F.lit(0.0), box["ymax"] - box["ymin"])


def overlap_ratio(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Overlap along one axis as a share of the shorter span, 0 to 1."""
    common, shorter = F.least(a_max, b_max) - F.greatest(a_min, b_min), F.least(a_max - a_min, b_max - b_min)
    return F.when((common > 0) & (shorter > 0), common / shorter).otherwise(F.lit(0.0))


def describable(box: Column, least: float = 0.02) -> Column:
    return area(box) >= least


def crop(box: Column, width: Column, height: Column, pad: float = 0.012) -> Column:
    """The padded box in whole pixels of the page's picture, at least one by one."""
    left, top = (F.greatest(F.lit(0), F.floor((box[k] - pad) * n)) for k, n in (("xmin", width), ("ymin", height)))
    right, bottom = (F.least(n, F.ceil((box[k] + pad) * n)) for k, n in (("xmax", width), ("ymax", height)))
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.lit(1), right - left).alias("width"), F.greatest(F.lit(1), bottom - top).alias("height"))


def citation_boxes(boxes: Column, legacy: Column) -> Column:
    """Usable boxes, put within the page, each once; the legacy box only where there is no list at all."""
    listed = F.when(F.size(boxes) > 0, boxes).otherwise(F.when(legacy.isNotNull(), F.array(legacy)))
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    good = F.transform(F.filter(listed, lambda b: usable(b)), lambda b: F.struct(*(clamp(b[k]).alias(k) for k in ("xmin", "ymin", "xmax", "ymax"))))
    return F.coalesce(F.array_distinct(good), F.filter(F.array(legacy), lambda b: F.lit(False)))


# documents and uploads


def loader_of(mime: Column) -> Column:
    """The loader of a MIME type; PDF where there is none."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LOADERS.items() for x in pair)), mime), F.lit("pdf"))


#: MIME types of the loaders.
LOADERS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/html": "html",
    "text/markdown": "markdown",
}


def section_unit(mime: Column) -> Column:
    """"section" for what has no pages; null for PDF and unknown."""
    return F.when(mime.isNotNull() & (mime != "") & (mime != "application/pdf"), "section")


def upload_error(size: Column, mime: Column, used: Column, most: int, allowed: list[str], quota: int) -> Column:
    """The first reason against an upload, null if there is none."""
    megabytes = round(most / (1 << 20))
    return (
        F.when(size <= 0, "File is empty.")
        .when(size > most, f"File exceeds the {megabytes} MB upload limit.")
        .when(~F.lower(mime).isin([m.lower() for m in allowed]), F.concat(F.lit('File type "'), mime, F.lit("\" isn't allowed.")))
        .when(used + size > quota, f"This would exceed your {quota >> 20} MB storage quota.")
    )


#: Address ranges that aren't the public internet (IANA special-purpose registry).
NOT_PUBLIC = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def v4_number(address: Column) -> Column:
    number = lambda parts: sum((F.element_at(parts, i + 1).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return bound(address, lambda a: F.when(a.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), bound(F.split(a, r"\."), number)))


def _blocked(n: Column) -> Column:
    found = F.lit(False)
    for block in NOT_PUBLIC:
        base, bits = block.split("/")
        number = sum(int(x) * 256 ** (3 - i) for i, x in enumerate(base.split(".")))
        size = 1 << (32 - int(bits))
        found = found | n.between(number // size * size, number // size * size + size - 1)
    return found


def public_v4(address: Column) -> Column:
    """False for addresses of the special ranges, and for all that is no IPv4 address."""
    return F.coalesce(bound(v4_number(address), lambda n: ~_blocked(n)), F.lit(False))


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def v6_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address as numbers, null for anything else. A dotted tail counts as two groups, a zone is left out."""
    none = F.array().cast("array<string>")
    tail = r"^(.*:)([0-9]+\.[0-9.]+)$"
    hexed = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n % 65536)))
    undotted = lambda t: F.when(t.rlike(tail), F.concat(F.regexp_extract(t, tail, 1), bound(v4_number(F.regexp_extract(t, tail, 2)), hexed))).otherwise(t)
    groups = lambda half: F.when(half == "", none).otherwise(F.split(half, ":"))

    def numbers(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        given = F.size(left) + F.size(right)
        fine = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(sides["short"], given <= 7).otherwise(given == 8)
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right)
        return F.when(fine, F.transform(every, lambda g: F.conv(g, 16, 10).cast("long")))

    sides = lambda halves: F.struct(groups(F.get(halves, F.lit(0))).alias("left"), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(none).alias("right"), (F.size(halves) == 2).alias("short"))
    text = bound(F.lower(F.split_part(address, F.lit("%"), F.lit(1))), undotted)
    return bound(bound(F.split(text, "::", 2), sides), numbers)


def public_address(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is on the public internet: global unicast but for documentation and 6to4; addresses that hold an IPv4 one (mapped, NAT64) are judged by it."""

    def six(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        mapped = (at(0) + at(1) + at(2) + at(3) + at(4) == 0) & (at(5) == 0xFFFF)
        nat64 = (at(0) == 0x64) & (at(1) == 0xFF9B)
        unicast = at(0).between(0x2000, 0x3FFF) & ~((at(0) == 0x2001) & (at(1) == 0xDB8)) & (at(0) != 0x2002)
        return F.when(mapped | nat64, bound(at(6) * 65536 + at(7), lambda n: ~_blocked(n))).otherwise(unicast)

    four = bound(v4_number(address), lambda n: F.when(n.isNotNull(), ~_blocked(n)))
    return F.coalesce(four, bound(v6_groups(address), six), F.lit(False))


def url_error(url: Column, hosts: list[str] | None = None) -> Column:
    """Why a page may not be fetched, by the form of its address; null if it may."""
    # each part of the address is read once, however often the checks use it
    begin = lambda u: F.struct(F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("rest"))
    parts = lambda s: F.struct(s["scheme"].alias("scheme"), s["rest"].alias("rest"), F.lower(F.regexp_extract(s["rest"], r"^(?:[^@]*@)?([^:]*)", 1)).alias("host"), F.regexp_extract(s["rest"], r":([0-9]+)$", 1).alias("port"))

    def reason(s: Column) -> Column:
        scheme, rest, host, port = (s[k] for k in ("scheme", "rest", "host", "port"))
        out = (
            F.when((scheme == "") | ((host == "") & scheme.isin("http", "https")), "That is not a valid web address.")
            .when(~scheme.isin("http", "https"), "Only http and https addresses can be added.")
            .when(F.contains(rest, F.lit("@")), "Addresses with a user name or password cannot be added.")
            .when((port != "") & (port != F.when(scheme == "https", "443").otherwise("80")), "Only the standard web ports can be used.")
        )
        if not hosts:
            return out
        fits = F.lit(False)
        for h in hosts:
            fits = fits | (host == h) | host.endswith(f".{h}")
        return F.coalesce(out, F.when(~fits, F.concat(host, F.lit(" is not on this server's list of allowed sites."))))

    return bound(bound(bound(url, begin), parts), reason)


# intents of questions

#: The phrases by which a question's kind is known.
WHOLE_DOCUMENT = r"(?i)\b(summar(y|ise|ize|ising|izing)|tl;?dr|overview|outline|gist|key points|main points|what(?:'s| is| are)? (?:in|this|it) (?:about|document|file|pdf)?|what does (?:this|it) (?:say|cover|contain)|tell me about)\b"
_DOCS = r"(?:documents?|docs?|files?|sources?|pdfs?|uploads?|knowledge ?bases?)"
LIST_QUESTION = "(?i)" + "|".join([
    rf"\b(?:what|which)\s+(?:\w+\s+){{0,2}}{_DOCS}\s+(?:do|does|can|could|are|is|have|did)\b",
    rf"\b(?:list|show|name|enumerate)\s+(?:me\s+)?(?:(?:all|the|my|your|our|of|every|each|available)\s+)*{_DOCS}\b",
    rf"\bhow many\s+{_DOCS}\b",
    r"\bwhat\s+(?:do|can)\s+you\s+(?:have access to|see|access|read)\b",
    r"\bwhat\s+(?:have|did)\s+i\s+upload(?:ed)?\b",
    r"\bwhat(?:'s|\s+is)\s+in\s+(?:my|this|the|our)\s+knowledge ?bases?\b",
    rf"\b{_DOCS}\s+(?:do you have|you have(?: access to)?|you can (?:see|access|read)|available)\b",
])
ABOUT_CONTENT = r"(?i)\b(?:mention(?:s|ed)?|say(?:s)?|said|cover(?:s|ed)?|discuss(?:es|ed)?|contain(?:s|ed|ing)?|talk(?:s)? about|describ(?:e|es|ed)|refer(?:s|red)? to|about|regarding|concerning|on the (?:topic|subject) of|explain(?:s)?|where|when|why|how (?:do|does|much|long|often)|with the|that has|that have|need(?:s|ed)?|should|must|require[sd]?|required|submit|bring|sign|for (?:a|an|the|my))\b"
FILLER = "(?i)^(?:thanks?(?: you| a lot| so much)?|ta|cheers|much appreciated|appreciate it|ok(?:ay)?|got it|understood|makes sense|perfect|great|nice|cool|awesome|brilliant|lovely|right|sure|fair enough|no worries|never mind|nvm|hi(?: there)?|hey(?: there)?|hello(?: there)?|good (?:morning|afternoon|evening)|yo|bye(?: bye)?|goodbye|see you(?: later)?|later|good night)$"
META = r"(?i)^(?:what can you do|who are you|what are you|how do you work|what is this|help)\b[\s?!.]*$"
REFERS_BACK = r"(?i)\b(it|its|it's|that|this|these|those|they|them|their|there|he|she|him|her|one|ones|same|above|earlier|previous|former|latter|else|instead|afterwards?|beforehand|meanwhile)\b"
REPLY_LEAD = r"(?i)^\s*(?:(?:and|but|also|so|or|then)\b|what about\b|how about\b|what if\b|no[,.!\s]|sorry\b|i meant\b)|\bi meant\b"
MULTI_PART = r"(?i)(\w.*\sand\s.*\?|\?.*\?|,\s*(?:and|or)\b|\b(?:compare[sd]?|comparison|versus|vs\.?|each|both|separately|difference between)\b|\bwhich\b(?:\s+\w+){0,3}\s+(?:more|less|longer|shorter|higher|lower|cheaper|sooner|later)\b|—|;)"
#: A question of so few words leans on the conversation.
SHORT_WORDS = 6


def title_key(text: Column) -> Column:
    """Lower case, separators and punctuation as single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[_\-.]+", " "), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def wants_document(question: Column) -> Column:
    return question.rlike(WHOLE_DOCUMENT)


def wants_list(question: Column) -> Column:
    q = F.trim(question)
    return (F.length(q) <= 160) & q.rlike(LIST_QUESTION) & ~q.rlike(ABOUT_CONTENT)


def turn_route(question: Column) -> Column:
    """Whole messages that are filler or ask about the assistant are answered directly."""
    q = F.trim(question)
    return F.when((q != "") & (q.rlike(META) | title_key(q).rlike(FILLER)), "answer-directly").otherwise("retrieve")


def plan_reason(question: Column, turns_before: Column) -> Column:
    q = F.trim(question)
    words = F.size(F.regexp_extract_all(F.lower(q), F.lit("([a-z0-9']+)")))
    back = (turns_before > 0) & (q.rlike(REFERS_BACK) | q.rlike(REPLY_LEAD) | (words <= SHORT_WORDS))
    return F.when(q.rlike(MULTI_PART), "multi-part").when(back, "follow-up").otherwise("standalone")


def page_route(chars: Column, columns: Column, items: Column, area_share: Column, images: Column, vector_ops: Column) -> Column:
    """How a page is read, by its signals; the certain conclusions come first."""
    dense = F.when(area_share > 0, items / (area_share * 100)).otherwise(F.lit(0.0)) >= 10
    return F.when(chars < 60, "no-text").when((columns >= 2) | dense, "structured").when((images >= 1) | (vector_ops >= 6), "image-heavy").otherwise("clean-text")


def pool_size(top_k: int, rerank_candidates: int | None) -> int:
    """Rows that are handed on to a reranker, if there is one."""
    return max(top_k, rerank_candidates) if rerank_candidates else top_k


def channel_size(bases: Column, top_k: int, pool: int, each: int = 20, ceiling: int = 200) -> Column:
    """Rows that a channel offers: more for more knowledge bases and for a widened pool, up to a ceiling."""
    offered = bases * each
    return F.least(F.greatest(offered, F.lit(pool)) if pool > top_k else offered, F.lit(ceiling))


def model_prices(text: str | None) -> dict[str, float]:
    """model=price pairs with commas between; the last = parts them. Raises ValueError on the first that is none."""
    out = {}
    for entry in filter(str.strip, (text or "").split(",")):
        model, found, price = entry.rpartition("=")
        try:
            amount = float(price.strip() or "0")
        except ValueError:
            amount = -1.0
        if not found or not model.strip() or not 0 <= amount < float("inf"):
            raise ValueError(f'"{entry.strip()}" is not model=price (dollars per million tokens)')
        out[model.strip()] = amount
    return out
