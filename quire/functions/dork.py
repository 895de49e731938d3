"""Search-engine query strings, composed of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values that queries must carry exactly.
BASE = "https://www.google.com/search"
LIBRARIES = ["archive.org", "gutenberg.org", "openlibrary.org", "oapen.org", "standardebooks.org", "pdfdrive.com"]
SHOPS = ["amazon.com", "goodreads.com", "barnesandnoble.com"]
ACADEMIC = ["site:.edu", "site:.ac.uk", "site:.edu.mx", "site:.edu.ar", "site:.edu.br", "site:.edu.co", "site:.edu.pe", "site:.edu.cl", "site:.ac.nz"]


def sanitize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\-.']", " "), r"\s+", " "))


def phrase(c: Column) -> Column:
    return F.concat(F.lit('"'), sanitize(c), F.lit('"'))


def url(raw: Column) -> Column:
    return F.concat(F.lit(BASE + "?q="), F.url_encode(raw), F.lit("&safe=active"))


def _given(c: Column) -> Column:
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def _chosen(c: Column) -> Column:
    return _given(c) & (c != "any")


def _record(strategy: str, parts: list[Column], operators: list[Column]) -> Column:
    raw = F.concat_ws(" ", *parts)
    ops = F.filter(F.array(*operators), lambda x: x.isNotNull())
    return F.struct(F.lit(strategy).alias("strategy"), raw.alias("raw_query"), url(raw).alias("google_url"), F.array_join(ops, ",").alias("operators"))


def direct(query: Column, author: Column, filetype: Column) -> Column:
    last = F.try_element_at(F.split(sanitize(author), " "), F.lit(-1))
    last = F.when(_given(author) & (F.length(last) > 2), last)
    ft = F.when(_chosen(filetype), filetype).otherwise("pdf")
    return _record("direct_pdf", [phrase(query), last, F.concat(F.lit("filetype:"), ft)], [F.lit("phrase"), F.when(last.isNotNull(), F.lit("author-lastname")), F.concat(F.lit("filetype:"), ft)])


def by_filetype(query: Column, filetype: Column, site: Column) -> Column:
    one = F.when(filetype == "pdf", F.lit("filetype:pdf")).when(_chosen(filetype), F.concat(F.lit("(filetype:"), filetype, F.lit(" OR filetype:pdf)"))).otherwise("(filetype:pdf OR filetype:epub OR filetype:mobi OR filetype:djvu)")
    where = F.when(_chosen(site), F.concat(F.lit("site:"), site)).otherwise(" ".join(f"-site:{s}" for s in SHOPS[:2]))
    ops = [F.lit("intitle"), F.when(_chosen(filetype), F.concat(F.lit("filetype:"), filetype)).otherwise("filetype:multi-pdf-first"), F.when(_chosen(site), F.lit("site")).otherwise("-site:shopping"), F.lit("-inurl:exclusions")]
    return _record("filetype", [F.concat(F.lit("intitle:"), phrase(query)), one, where, F.lit("-inurl:login -inurl:register")], ops)


def open_library(query: Column, author: Column) -> Column:
    a = F.when(_given(author), phrase(author))
    return _record("open_library", [F.concat(F.lit("intitle:"), phrase(query)), a, F.lit("(" + " OR ".join(f"site:{s}" for s in LIBRARIES) + ")")], [F.lit("intitle"), F.when(_given(author), F.lit("author-phrase")), F.lit("site:open-libraries")])


def index_of(query: Column, filetype: Column) -> Column:
    ext = F.when(_chosen(filetype), F.concat(F.lit('".'), filetype, F.lit('"'))).otherwise('(".pdf" OR ".epub" OR ".mobi")')
    return _record("index_of", [F.lit('(intitle:"index of" OR intitle:"parent directory")'), phrase(query), ext, F.lit("-inurl:login")], [F.lit("intitle:directory-listing"), F.lit("phrase"), F.lit("ext-in-listing"), F.lit("-inurl:login")])


def by_isbn(isbn: Column) -> Column:
    return _record("isbn", [phrase(isbn), F.lit("intext:isbn (filetype:pdf OR filetype:epub)")], [F.lit("isbn-phrase"), F.lit("intext:isbn"), F.lit("filetype:multi")])


def google_books(query: Column, author: Column) -> Column:
    a = F.when(_given(author), F.concat(F.lit("intext:"), phrase(author)))
    return _record("google_books", [F.lit("site:books.google.com"), F.concat(F.lit("intitle:"), phrase(query)), a, F.lit("inurl:/books/edition/")], [F.lit("site:google-books"), F.lit("intitle"), F.when(_given(author), F.lit("intext:author")), F.lit("inurl:edition")])


def academic(query: Column, author: Column) -> Column:
    a = F.when(_given(author), phrase(author))
    return _record("academic", [phrase(query), a, F.lit("(" + " OR ".join(ACADEMIC) + ")"), F.lit("(filetype:pdf OR filetype:epub)")], [F.lit("phrase"), F.when(_given(author), F.lit("author-phrase")), F.lit("site:academic-domains"), F.lit("filetype:multi")])


def download_page(query: Column, author: Column) -> Column:
    a = F.when(_given(author), phrase(author))
    return _record("download_page", [F.concat(F.lit("intitle:"), phrase(query)), a, F.lit("inurl:(download OR pdf OR ebook OR book)"), F.lit("(filetype:pdf OR filetype:epub OR filetype:mobi)"), F.lit(" ".join(f"-site:{s}" for s in SHOPS))], [F.lit("intitle"), F.when(_given(author), F.lit("author-phrase")), F.lit("inurl:download-hints"), F.lit("filetype:multi"), F.lit("-site:shopping")])


def primary(query: Column, author: Column, isbn: Column, filetype: Column, site: Column) -> Column:
    """One query: by ISBN, else by site, else by another file type than PDF, else direct."""
    return F.when(_given(isbn), by_isbn(isbn)).when(_chosen(site), by_filetype(query, F.when(_given(filetype), filetype).otherwise("pdf"), site)).when(_chosen(filetype) & (filetype != "pdf"), by_filetype(query, filetype, F.lit("any"))).otherwise(direct(query, author, filetype))


def every(query: Column, author: Column, isbn: Column, filetype: Column, site: Column) -> Column:
    """All strategies in their order, that by ISBN first where there is one."""
    rest = F.array(direct(query, author, filetype), by_filetype(query, filetype, site), open_library(query, author), index_of(query, filetype), google_books(query, author), academic(query, author), download_page(query, author))
    return F.when(_given(isbn), F.concat(F.array(by_isbn(isbn)), rest)).otherwise(rest)


def client(title: Column, author: Column, filetype: Column) -> tuple[Column, Column]:
    """The two links a page offers beside a hit: with the file type as an operator, and as a plain word."""
    kind = F.when(_chosen(filetype), filetype).otherwise("pdf")
    last = F.try_element_at(F.split(F.trim(F.replace(author, F.lit('"'), F.lit(""))), r"\s+"), F.lit(-1))
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce(title, F.lit("")), F.lit('"'), F.lit("")), F.lit('"'))
    # as browsers encode: blanks as %20, and a few signs left as they are
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%21"), F.lit("!")), F.lit("%27"), F.lit("'")), F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")")), F.lit("%7E"), F.lit("~"))
    made = lambda what: F.concat(F.lit(BASE + "?q="), plain(F.concat_ws(" ", quoted, what, F.when(F.length(last) > 2, last))))
    return made(F.concat(F.lit("filetype:"), kind)), made(kind)
