"""Fixed values of the data model: fields, aliases, rubric, suffixes, export headers."""

from __future__ import annotations

#: Key, label and header aliases of the canonical fields, in order.
FIELDS = (
    ("company", "Company Name", ("company", "company name", "account name", "company_name", "account", "organization", "org", "business name", "employer")),
    ("domain", "Website / Domain", ("domain", "website", "url", "company domain", "web site", "company website", "site")),
    ("email", "Email", ("email", "e-mail", "email address", "work email", "contact email")),
    ("firstName", "First Name", ("first name", "firstname", "first", "given name")),
    ("lastName", "Last Name", ("last name", "lastname", "last", "surname", "family name")),
    ("title", "Job Title", ("title", "job title", "role", "position")),
    ("phone", "Phone", ("phone", "phone number", "telephone", "mobile")),
    ("industry", "Industry", ("industry", "sector", "vertical")),
    ("employeeCount", "Employee Count", ("employee count", "employees", "company size", "headcount", "# employees")),
    ("country", "Country", ("country", "nation")),
    ("state", "State / Region", ("state", "region", "province", "state/province")),
    ("city", "City", ("city", "town")),
    ("linkedin", "LinkedIn URL", ("linkedin", "linkedin url", "linkedin profile")),
)
#: Legal suffixes of company names.
SUFFIXES = (
    "inc", "incorporated", "llc", "l.l.c", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "llp", "lp", "pllc",
    "pty", "pty ltd", "sa", "s.a", "ag", "nv", "bv", "oy", "as", "srl", "kk", "co ltd", "holdings", "group", "international", "intl",
)
#: Headers of the export.
EXPORT_HEADERS = (
    "Company", "Domain", "Email", "First Name", "Last Name", "Title", "Phone", "Industry", "Employees", "Country", "State", "City",
    "LinkedIn", "Enrichment Score", "Enrichment Ready", "Missing Required Fields",
)
#: Labels of the reasons for a duplicate.
REASONS = {"exact-domain": "exact domain match", "exact-name": "exact normalized-name match", "fuzzy-name": "fuzzy name match"}
THRESHOLD, SOFT_ROWS = 0.85, 5000

KEYS = tuple(key for key, _, _ in FIELDS)
LABELS = {key: label for key, label, _ in FIELDS}


def column_of(key: str) -> str:
    """firstName -> first_name."""
    return "".join("_" + c.lower() if c.isupper() else c for c in key)
