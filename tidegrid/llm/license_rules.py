"""The ordered license signatures: families by name and identifier, times the forms in which texts state a license, and clauses of license texts.

A rule is (rank, label, keyword, pattern, confidence, head). Patterns see text with A-Z lower-cased and runs of white space as one space. A lower rank
wins. A rule runs only on texts that hold its keyword, so the keyword must occur in every text that the pattern matches. A rule with a head, a pattern
with which its own begins, is tried only where that matches: rules of one form share the search for it. A detection is the pattern's group `at` if it has one:
the identifiers of one expression ("MIT OR Apache-2.0") begin with the same head but stand side by side.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rank: int
    label: str
    keyword: str
    pattern: str
    confidence: float
    head: str | None = None
    #: Says nothing where a license stands anywhere in the text: a holder may reserve rights and grant a license in one notice.
    alone: bool = False


#: (label, identifier pattern, keyword of the identifier, name pattern, keyword of the name, address pattern)
FAMILIES = [
    ("mit", r"mit", "mit", r"(?:mit|expat)\s+licen[cs]e", "licen", r"opensource\.org/licenses?/mit(?:-license)?"),
    ("mit-0", r"mit-0", "mit-0", r"mit\s+no\s+attribution(?:\s+licen[cs]e)?", "no attribution", r"opensource\.org/licenses?/mit-0"),
    ("apache-2.0", r"apache-2\.0", "apache", r"apache(?:\s+software)?\s+licen[cs]e,?\s*(?:\(?version\s+|v\.?\s*)?2(?:\.0)?", "apache", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", r"apache-1\.1", "apache", r"apache(?:\s+software)?\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)?1\.1", "apache", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", r"apache-1\.0", "apache", r"apache(?:\s+software)?\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)?1\.0", "apache", r"apache\.org/licenses/license-1\.0"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", "gpl-3", r"(?:gnu\s+)?(?<!lesser\s)(?<!library\s)(?<!affero\s)general\s+public\s+licen[cs]e,?\s*(?:as\s+published\s+by\s+[a-z\s]{1,40},?\s*)?(?:either\s+)?(?:\(?version\s+|v\.?\s*)3(?:\.0)?", "general", r"gnu\.org/licenses/gpl-3\.0(?:-standalone)?"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", "gpl-2", r"(?:gnu\s+)?(?<!lesser\s)(?<!library\s)(?<!affero\s)general\s+public\s+licen[cs]e,?\s*(?:as\s+published\s+by\s+[a-z\s]{1,40},?\s*)?(?:either\s+)?(?:\(?version\s+|v\.?\s*)2(?:\.0)?", "general", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", "gpl-1", r"(?:gnu\s+)?(?<!lesser\s)(?<!library\s)(?<!affero\s)general\s+public\s+licen[cs]e,?\s*(?:\(?version\s+|v\.?\s*)1(?:\.0)?", "general", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", "lgpl-3", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)3(?:\.0)?", "lesser", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", "lgpl-2", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)2\.1", "lesser", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", "lgpl-2", r"(?:gnu\s+)?(?:library|lesser)\s+general\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)2(?:\.0)?(?!\.\d)", "general", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", "agpl-3", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)3(?:\.0)?", "affero", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", "gfdl", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)1\.3", "documentation", r"gnu\.org/licenses/fdl-1\.3"),
    ("bsd-2-clause", r"bsd-2-clause", "bsd", r"(?:simplified\s+bsd|bsd\s+2-clause|2-clause\s+bsd|freebsd)\s+licen[cs]e", "bsd", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"bsd-3-clause", "bsd", r"(?:(?:new|revised|modified)\s+bsd|bsd\s+3-clause|3-clause\s+bsd)\s+licen[cs]e", "bsd", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", r"bsd-4-clause", "bsd", r"(?:original\s+bsd|bsd\s+4-clause|4-clause\s+bsd)\s+licen[cs]e", "bsd", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", r"0bsd", "0bsd", r"(?:zero-clause\s+bsd|bsd\s+zero\s+clause)(?:\s+licen[cs]e)?", "bsd", r"opensource\.org/licenses?/0bsd"),
    ("isc", r"isc", "isc", r"isc\s+licen[cs]e", "isc", r"opensource\.org/licenses?/isc(?:-license)?"),
    ("mpl-2.0", r"mpl-2\.0", "mpl-2", r"mozilla\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)?2(?:\.0)?", "mozilla", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", r"mpl-1\.1", "mpl-1", r"mozilla\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)?1\.1", "mozilla", r"mozilla\.org/(?:en-us/)?mpl/1\.1"),
    ("epl-2.0", r"epl-2\.0", "epl-2", r"eclipse\s+public\s+licen[cs]e\s*,?\s*(?:-\s*)?(?:version\s+|v\.?\s*)?2(?:\.0)?", "eclipse", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", r"epl-1\.0", "epl-1", r"eclipse\s+public\s+licen[cs]e\s*,?\s*(?:-\s*)?(?:version\s+|v\.?\s*)?1(?:\.0)?", "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("cddl-1.0", r"cddl-1\.0", "cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e", "distribution", r"opensource\.org/licenses?/cddl(?:-?1(?:\.0)?)?"),
    ("cpl-1.0", r"cpl-1\.0", "cpl", r"common\s+public\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.0", "common", r"opensource\.org/licenses?/cpl(?:-?1\.0)?"),
    ("artistic-2.0", r"artistic-2\.0", "artistic", r"artistic\s+licen[cs]e,?\s*(?:version\s+)?2(?:\.0)?", "artistic", r"opensource\.org/licenses?/artistic-license-2\.0"),
    ("artistic-1.0", r"artistic-1\.0", "artistic", r"artistic\s+licen[cs]e,?\s*(?:version\s+)?1(?:\.0)?", "artistic", r"opensource\.org/licenses?/artistic-license-1\.0"),
    ("bsl-1.0", r"bsl-1\.0", "bsl", r"boost\s+software\s+licen[cs]e", "boost", r"boost\.org/license_1_0"),
    ("zlib", r"zlib", "zlib", r"zlib(?:/libpng)?\s+licen[cs]e", "zlib", r"opensource\.org/licenses?/zlib(?:-license)?"),
    ("unlicense", r"unlicense", "unlicense", r"the\s+unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", r"wtfpl", "wtfpl", r"do\s+what\s+the\s+f\S{1,3}\s+you\s+want\s+to\s+public\s+licen[cs]e", "public", r"wtfpl\.net"),
    ("psf-2.0", r"psf-2\.0", "psf", r"python\s+software\s+foundation\s+licen[cs]e", "python", r"python\.org/psf/license"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql\s+licen[cs]e", "postgresql", r"postgresql\.org/about/licence"),
    ("eupl-1.2", r"eupl-1\.2", "eupl", r"european\s+union\s+public\s+licen[cs]e,?\s*(?:v(?:ersion|\.)?\s*)?1\.2", "european", r"joinup\.ec\.europa\.eu/\S{0,80}?eupl\S{0,80}"),
    ("osl-3.0", r"osl-3\.0", "osl", r"open\s+software\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?3\.0", "open", r"opensource\.org/licenses?/osl-3\.0"),
    ("ofl-1.1", r"ofl-1\.1", "ofl", r"sil\s+open\s+font\s+licen[cs]e", "font", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", r"odbl-1\.0", "odbl", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e", "database", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"odc-by-1\.0", "odc-by", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", "attribution", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", r"pddl-1\.0", "pddl", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", "dedication", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", r"cc0(?:-1\.0)?", "cc0", r"creative\s+commons\s+(?:zero|cc0)(?:\s+v?1\.0)?(?:\s+universal)?", "creative", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-4.0", r"cc-by-4\.0", "cc-by", r"(?:cc(?:-|\s+)by\s+4\.0|creative\s+commons\s+attribution\s+4\.0)", "4.0", r"creativecommons\.org/licenses/by/4"),
    ("cc-by-3.0", r"cc-by-3\.0", "cc-by", r"(?:cc(?:-|\s+)by\s+3\.0|creative\s+commons\s+attribution\s+3\.0)", "3.0", r"creativecommons\.org/licenses/by/3"),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", "cc-by-sa", r"(?:cc(?:-|\s+)by-sa\s+4\.0|creative\s+commons\s+attribution(?:-|\s+)share-?alike\s+4\.0)", "4.0", r"creativecommons\.org/licenses/by-sa/4"),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", "cc-by-sa", r"(?:cc(?:-|\s+)by-sa\s+3\.0|creative\s+commons\s+attribution(?:-|\s+)share-?alike\s+3\.0)", "3.0", r"creativecommons\.org/licenses/by-sa/3"),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", "cc-by-nc", r"(?:cc(?:-|\s+)by-nc\s+4\.0|creative\s+commons\s+attribution(?:-|\s+)non-?commercial\s+4\.0)", "4.0", r"creativecommons\.org/licenses/by-nc/4"),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", "cc-by-nc-sa", r"(?:cc(?:-|\s+)by-nc-sa\s+4\.0|creative\s+commons\s+attribution(?:-|\s+)non-?commercial(?:-|\s+)share-?alike\s+4\.0)", "4.0", r"creativecommons\.org/licenses/by-nc-sa/4"),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", "cc-by-nd", r"(?:cc(?:-|\s+)by-nd\s+4\.0|creative\s+commons\s+attribution(?:-|\s+)no-?deriv\w*\s+4\.0)", "4.0", r"creativecommons\.org/licenses/by-nd/4"),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", "cc-by-nc-nd", r"(?:cc(?:-|\s+)by-nc-nd\s+4\.0|creative\s+commons\s+attribution(?:-|\s+)non-?commercial(?:-|\s+)no-?deriv\w*\s+4\.0)", "4.0", r"creativecommons\.org/licenses/by-nc-nd/4"),
    ("ms-pl", r"ms-pl", "ms-pl", r"microsoft\s+public\s+licen[cs]e", "microsoft", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"ms-rl", "ms-rl", r"microsoft\s+reciprocal\s+licen[cs]e", "microsoft", r"opensource\.org/licenses?/ms-rl"),
    ("ncsa", r"ncsa", "ncsa", r"university\s+of\s+illinois/ncsa\s+(?:open\s+source\s+)?licen[cs]e", "ncsa", r"opensource\.org/licenses?/ncsa"),
    ("openssl", r"openssl", "openssl", r"openssl\s+licen[cs]e", "openssl", r"openssl\.org/source/license"),
    ("busl-1.1", r"busl-1\.1", "busl", r"business\s+source\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.1", "business", r"mariadb\.com/bsl11"),
    ("sspl-1.0", r"sspl-1\.0", "sspl", r"server\s+side\s+public\s+licen[cs]e", "server", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", r"elastic-2\.0", "elastic", r"elastic\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?2(?:\.0)?", "elastic", r"elastic\.co/licensing/elastic-license(?:-2\.0)?"),
]

#: Short names: (label, keyword, pattern, whether the name alone tells, without a grant or a field before it).
SHORT = [
    ("gpl-3.0", "gpl", r"gpl(?:-|,?\s?v(?:ersion|\.)?\s?)3(?:\.0)?(?:\+|-only|-or-later)?", True),
    ("gpl-2.0", "gpl", r"gpl(?:-|,?\s?v(?:ersion|\.)?\s?)2(?:\.0)?(?:\+|-only|-or-later)?", True),
    ("lgpl-3.0", "lgpl", r"lgpl(?:-|,?\s?v(?:ersion|\.)?\s?)3(?:\.0)?(?:\+|-only|-or-later)?", True),
    ("lgpl-2.1", "lgpl", r"lgpl(?:-|,?\s?v(?:ersion|\.)?\s?)2\.1(?:\+|-only|-or-later)?", True),
    ("agpl-3.0", "agpl", r"agpl(?:-|,?\s?v(?:ersion|\.)?\s?)3(?:\.0)?(?:\+|-only|-or-later)?", True),
    ("gpl-3.0", "gpl", r"(?:gnu\s)?gpl\s3(?:\.0)?\+?", False),
    ("gpl-2.0", "gpl", r"(?:gnu\s)?gpl\s2(?:\.0)?\+?", False),
    ("gpl", "gpl", r"(?:gnu\s)?gpl", False),
    ("lgpl", "lgpl", r"(?:gnu\s)?lgpl", False),
    ("agpl", "agpl", r"(?:gnu\s)?agpl", False),
    ("apache-2.0", "apache", r"apache[\s-]?(?:v(?:ersion|\.)?\s?)?2(?:\.0)?", False),
    ("apache-2.0", "apache", r"apache[\s-](?:v(?:ersion|\.)?\s?)?2(?:\.0)?[\s-]licen[cs]ed?", True),
    ("mit", "mit", r"mit[\s-]licen[cs]ed", True),
    ("mit", "mit", r"(?:mit/x11|x11/mit|mit/expat|mit\s\((?:x11|expat)\))(?:\slicen[cs]e)?", True),
    ("mit", "mit", r"mit(?=\s?[.,;:)\"'`]|\s?$|\s(?:or|and|terms)\W)", False),
    ("bsd-3-clause", "bsd", r"bsd[\s-](?:3|three)[\s-]clause(?:\s[\"']?new[\"']?\sor\s[\"']?revised[\"']?)?(?:\slicen[cs]e)?", True),
    ("bsd-3-clause", "bsd", r"(?:3|three)[\s-]clause\sbsd(?:\slicen[cs]e)?", True),
    ("bsd-2-clause", "bsd", r"bsd[\s-](?:2|two)[\s-]clause(?:\s[\"']?(?:simplified|freebsd)[\"']?)?(?:\slicen[cs]e)?", True),
    ("bsd-2-clause", "bsd", r"(?:2|two)[\s-]clause\sbsd(?:\slicen[cs]e)?", True),
    ("bsd", "bsd", r"bsd", False),
    ("mpl-2.0", "mpl", r"mpl(?:-|\s?v?)2(?:\.0)?", True),
    ("cc0-1.0", "cc0", r"cc0", False),
]

#: Names without a version, whose license has several: (label, keyword, pattern, whether the name alone tells).
UNVERSIONED = [
    ("gfdl", "documentation", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e", True),
    ("cpl", "common", r"common\s+public\s+licen[cs]e", True),
    ("eupl", "european", r"european\s+union\s+public\s+licen[cs]e", True),
    ("osl", "open", r"open\s+software\s+licen[cs]e", False),
    ("busl", "business", r"business\s+source\s+licen[cs]e", True),
    ("elastic", "elastic", r"elastic\s+licen[cs]e", False),
]

#: The forms in which a text states a license, by falling weight: (rank, confidence, keyword or None for the family's, pattern with its place).
GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistribut\w+|modif\w+)\s+(?:it\s+)?under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?"

RESERVED = "all rights reserved"

#: Clauses of license texts and notices: (label, keyword, pattern, confidence).
CLAUSES = [
    ("mit", "hereby granted", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 0.95),
    ("isc", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", 0.9),
    ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 0.85),
    ("bsd-3-clause", "endorse or promote", r"neither\s+the\s+names?\s+of\s+[\s\S]{1,120}?\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote", 0.9),
    ("apache-2.0", "limitations under the license", r"see\s+the\s+license\s+for\s+the\s+specific\s+language\s+governing\s+permissions\s+and\s+limitations\s+under\s+the\s+license", 0.95),
    ("gpl", "free software", r"this\s+program\s+is\s+free\s+software[:;,]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify", 0.9),
    ("mpl-2.0", "source code form", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public", 0.95),
    ("unlicense", "unencumbered software", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", 0.95),
    ("zlib", "altered source versions", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked", 0.9),
    ("bsl-1.0", "boost software", r"distributed\s+under\s+the\s+boost\s+software\s+license", 0.95),
    ("public-domain", "public domain", r"(?:placed|released|dedicated)\s+(?:in|into|to)\s+the\s+public\s+domain", 0.7),
    ("proprietary", RESERVED, r"all\s+rights\s+reserved", 0.3),
    ("proprietary", "confidential", r"proprietary\s+and\s+confidential", 0.5),
    ("gpl", "gnu gpl", r"gnu\s+gpl", 0.7),
    ("lgpl", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e", 0.8),
    ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e", 0.8),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[cs]e", 0.7),
    ("epl", "eclipse", r"eclipse\s+public\s+licen[cs]e", 0.7),
    ("creative-commons", "creative commons", r"creative\s+commons", 0.5),
    ("bsd", "bsd", r"bsd(?:-style)?\s+licen[cs]e", 0.7),
]


#: The heads of the forms of ranks 1 and 4, what may stand between them and an identifier (the expression's identifiers before it), and what may not
#: follow an address or a short name.
TAG, FIELD = r"spdx-license-identifier:\s*", r"[\"']?licen[cs]es?[\"']?\s*[:=]\s*\[?[\"']?"
BEFORE, END, STOP = r"(?:[(\s]*[\w.+-]+[)\s]*(?:/|,|(?<=[\s)])(?:or|and|with)(?=[\s(]))){0,30}[(\s]*", r"(?!\w|-\w)", r"(?!\w|[.-]\w|\+\w)"


def host(place: str) -> str:
    return place.split("/")[0].replace("\\", "")


def site(place: str) -> str:
    """The head of an address, with or without a scheme before it."""
    return r"(?<![\w-])" + place.split("/")[0]


def rules() -> list[Rule]:
    """All rules in order: rank first, then the order of the tables above."""
    stated = lambda head, what: rf"{head}{BEFORE}(?P<at>{what})"
    out = [Rule(1, label, key, rf"{stated(TAG, ident)}(?![\w.-])", 1.0, TAG) for label, ident, key, *_ in FAMILIES]
    out += [Rule(2, label, key, rf"{GRANT}{name}(?!\w)", 0.95, GRANT) for label, _, _, name, key, _ in FAMILIES]
    out += [Rule(2, label, key, rf"{GRANT}{ident}(?![\w-])", 0.9, GRANT) for label, ident, key, *_ in FAMILIES if "-" in ident]
    out += [Rule(2, label, key, rf"{GRANT}{short}{STOP}", 0.9, GRANT) for label, key, short, _ in SHORT]
    out += [Rule(2, label, key, rf"{GRANT}{name}(?!\w)", 0.8, GRANT) for label, key, name, _ in UNVERSIONED]
    out += [Rule(3, label, host(place), rf"(?<![\w-]){place}{END}", 0.9, site(place)) for label, *_, place in FAMILIES]
    out += [Rule(4, label, key, rf"{stated(FIELD, ident)}(?![\w.-])", 0.9, FIELD) for label, ident, key, *_ in FAMILIES]
    out += [Rule(4, label, key, rf"{stated(FIELD, short)}{STOP}", 0.85, FIELD) for label, key, short, _ in SHORT]
    out += [Rule(5, label, key, rf"(?<!\w){pattern}(?!\w)", weight, alone=key == RESERVED) for label, key, pattern, weight in CLAUSES[:12]]
    out += [Rule(6, label, key, rf"(?<!\w){name}(?!\w)", 0.8) for label, _, _, name, key, _ in FAMILIES]
    out += [Rule(6, label, key, rf"(?<!\w){short}{STOP}", 0.8) for label, key, short, told in SHORT if told]
    out += [Rule(7, label, key, rf"(?<!\w){name}(?!\w)", 0.6) for label, key, name, told in UNVERSIONED if told]
    out += [Rule(7, label, key, rf"(?<!\w){pattern}(?!\w)", weight) for label, key, pattern, weight in CLAUSES[12:]]
    return sorted(out, key=lambda r: r.rank)


#: The phrases whose every place is reported, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
