"""Signature rules of the licence scan.

Patterns match texts as the scan normalises them: lower-case words of letters and digits, one space between words
("SPDX-License-Identifier: GPL-3.0" reads "spdx license identifier gpl 3 0"). A rule is tried only where its keyword,
or one of them, occurs. Smaller priorities win: 1 an explicit grant or identifier, 2 a licence text, 3 a licence's name, 4 a hint.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule: str
    label: str
    keyword: str
    priority: int
    pattern: str


#: A licence: label, keywords of which every mention of it holds one, pattern of its name, pattern of its identifier.
LICENCES = [
    ("mit", "mit", r"(?:the )?mit(?: x11)?", r"mit"),
    ("mit-0", "no attribution", r"(?:the )?mit no attribution", r"mit 0"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)? licen[sc]e (?:version |v)?1 1", r"apache 1 1"),
    ("apache-2", "apache", r"(?:the )?apache(?: software)?(?: licen[sc]e)?,? ?(?:version |v)?2(?: 0)?", r"apache 2 0"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause"),
    ("bsd-0-clause", "bsd", r"(?:the )?(?:0bsd|zero clause bsd|bsd zero clause)", r"0bsd"),
    ("isc", "isc", r"(?:the )?isc", r"isc"),
    ("gpl-1", "gpl|general public", r"(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)? (?:version |v)?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl|general public", r"(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)? ?(?:version |v)?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl|general public", r"(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)? ?(?:version |v)?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "lgpl|library general", r"(?:the )?(?:gnu )?(?:lgpl|library general public licen[sc]e) ?(?:version |v)?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl|lesser general", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[sc]e) ?(?:version |v)?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl|lesser general", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[sc]e) ?(?:version |v)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl|affero", r"(?:the )?(?:gnu )?(?:agpl|affero general public licen[sc]e) ?(?:version |v)?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl-1.2", "gfdl|free documentation", r"(?:the )?(?:gnu )?(?:gfdl|free documentation licen[sc]e) (?:version |v)?1 2", r"gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "gfdl|free documentation", r"(?:the )?(?:gnu )?(?:gfdl|free documentation licen[sc]e) (?:version |v)?1 3", r"gfdl 1 3(?: only| or later)?"),
    ("mpl-1.1", "mpl|mozilla", r"(?:the )?(?:mpl|mozilla public licen[sc]e) ?(?:version |v)?1 1", r"mpl 1 1"),
    ("mpl-2", "mpl|mozilla", r"(?:the )?(?:mpl|mozilla public licen[sc]e) ?(?:version |v)?2 0", r"mpl 2 0"),
    ("epl-1", "epl|eclipse", r"(?:the )?(?:epl|eclipse public licen[sc]e) ?(?:version |v)?1 0", r"epl 1 0"),
    ("epl-2", "epl|eclipse", r"(?:the )?(?:epl|eclipse public licen[sc]e) ?(?:version |v)?2 0", r"epl 2 0"),
    ("edl-1", "eclipse", r"(?:the )?eclipse distribution licen[sc]e(?: (?:version |v)?1 0)?", r"edl 1 0"),
    ("cddl-1", "cddl|common development", r"(?:the )?(?:cddl|common development and distribution licen[sc]e) ?(?:version |v)?1 [01]", r"cddl 1 [01]"),
    ("cpl-1", "cpl|common public", r"(?:the )?(?:cpl|common public licen[sc]e) ?(?:version |v)?1 0", r"cpl 1 0"),
    ("cpal-1", "cpal|common public", r"(?:the )?(?:cpal|common public attribution licen[sc]e) ?(?:version |v)?1 0", r"cpal 1 0"),
    ("artistic-1", "artistic", r"(?:the )?artistic licen[sc]e (?:version |v)?1 0", r"artistic 1 0"),
    ("artistic-2", "artistic", r"(?:the )?artistic licen[sc]e (?:version |v)?2 0", r"artistic 2 0"),
    ("bsl-1", "boost", r"(?:the )?boost software licen[sc]e(?: (?:version |v)?1 0)?", r"bsl 1 0"),
    ("busl-1.1", "business source", r"(?:the )?business source licen[sc]e(?: (?:version |v)?1 1)?", r"busl 1 1"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", r"zlib"),
    ("libpng", "libpng", r"(?:the )?libpng", r"libpng 2 0"),
    ("unlicense", "unlicen", r"(?:the )?unlicen[sc]e", r"unlicense"),
    ("wtfpl", "want to public", r"(?:the )?do what the f\S+ you want to public licen[sc]e", r"wtfpl"),
    ("eupl-1.2", "eupl|european union", r"(?:the )?(?:eupl|european union public licen[sc]e) ?(?:version |v)?1 2", r"eupl 1 2"),
    ("eupl-1.1", "eupl|european union", r"(?:the )?(?:eupl|european union public licen[sc]e) ?(?:version |v)?1 1", r"eupl 1 1"),
    ("osl-3", "osl|open software", r"(?:the )?(?:osl|open software licen[sc]e) ?(?:version |v)?3 0", r"osl 3 0"),
    ("afl-3", "afl|academic free", r"(?:the )?(?:afl|academic free licen[sc]e) ?(?:version |v)?3 0", r"afl 3 0"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal licen[sc]e", r"ms rl"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    ("postgresql", "postgresql", r"(?:the )?postgresql", r"postgresql"),
    ("psf-2", "python", r"(?:the )?python(?: software foundation)? licen[sc]e(?: (?:version |v)?2)?", r"psf 2 0"),
    ("php-3", "php", r"(?:the )?php licen[sc]e(?: (?:version |v)?3 01)?", r"php 3 01"),
    ("ruby", "ruby", r"(?:the )?ruby", r"ruby"),
    ("vim", "vim", r"(?:the )?vim", r"vim"),
    ("openssl", "openssl", r"(?:the )?(?:dual )?openssl(?: and ssleay)?", r"openssl"),
    ("curl", "curl", r"(?:the )?curl", r"curl"),
    ("ofl-1.1", "font", r"(?:the )?(?:sil )?open font licen[sc]e(?: (?:version |v)?1 1)?", r"ofl 1 1"),
    ("odbl-1", "open d", r"(?:the )?open (?:data commons open )?database licen[sc]e(?: (?:version |v)?1 0)?", r"odbl 1 0"),
    ("odc-by-1", "open data", r"(?:the )?open data commons attribution licen[sc]e", r"odc by 1 0"),
    ("pddl-1", "public domain", r"(?:the )?(?:open data commons )?public domain dedication and licen[sc]e", r"pddl 1 0"),
    ("cc0-1", "cc0", r"(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", "cc by|commons by", r"(?:the )?(?:cc|creative commons) by(?: [1-4] [05])?(?: international| unported)?", r"cc by [1-4] [05]"),
    ("cc-by-sa", "by sa", r"(?:the )?(?:cc|creative commons) by sa(?: [1-4] [05])?(?: international| unported)?", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "by nd", r"(?:the )?(?:cc|creative commons) by nd(?: [1-4] [05])?(?: international| unported)?", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "by nc", r"(?:the )?(?:cc|creative commons) by nc(?: [1-4] [05])?(?: international| unported)?", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "by nc sa", r"(?:the )?(?:cc|creative commons) by nc sa(?: [1-4] [05])?(?: international| unported)?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "by nc nd", r"(?:the )?(?:cc|creative commons) by nc nd(?: [1-4] [05])?(?: international| unported)?", r"cc by nc nd [1-4] [05]"),
    ("upl-1", "universal permissive", r"(?:the )?universal permissive licen[sc]e(?: (?:version |v)?1 0)?", r"upl 1 0"),
    ("sspl-1", "server side", r"(?:the )?server side public licen[sc]e(?: (?:version |v)?1)?", r"sspl 1 0"),
    ("elastic-2", "elastic", r"(?:the )?elastic licen[sc]e(?: (?:version |v)?2(?: 0)?)?", r"elastic 2 0"),
    ("blueoak-1", "blue oak", r"(?:the )?blue oak model licen[sc]e(?: 1 0 0)?", r"blueoak 1 0 0"),
    ("mulan-2", "mulan", r"(?:the )?mulan (?:psl|permissive software licen[sc]e)(?: (?:version |v)?2)?", r"mulanpsl 2 0"),
    ("openrail-m", "rail", r"(?:the )?(?:creativeml |bigscience )?open ?rail(?: m)?", r"openrail m"),
    ("w3c", "w3c", r"(?:the )?w3c software(?: and document)?(?: notice and)?", r"w3c"),
    ("unicode", "unicode", r"(?:the )?unicode(?: data files and software| terms of use)?", r"unicode 3 0"),
    ("zpl-2.1", "zope", r"(?:the )?zope public licen[sc]e(?: (?:version |v)?2 1)?", r"zpl 2 1"),
    ("ecl-2", "educational", r"(?:the )?educational community licen[sc]e(?: (?:version |v)?2 0)?", r"ecl 2 0"),
    ("qpl-1", "q public", r"(?:the )?q public licen[sc]e(?: (?:version |v)?1 0)?", r"qpl 1 0"),
]

#: Other names of a licence, which do not hold its keyword: label, what rules of the name are called, keyword, pattern.
ALIASES = [
    ("mit", "expat", "expat", r"(?:the )?expat(?: x11)?"),
    ("bsd-0-clause", "free-public", "free public licen", r"(?:the )?free public licen[sc]e"),
    ("cc-by", "attribution", "attribution", r"(?:the )?(?:cc|creative commons) attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "attribution", "attribution share", r"(?:the )?(?:cc|creative commons) attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "attribution", "attribution no", r"(?:the )?(?:cc|creative commons) attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "attribution", "attribution non", r"(?:the )?(?:cc|creative commons) attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "attribution", "attribution non", r"(?:the )?(?:cc|creative commons) attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "attribution", "attribution non", r"(?:the )?(?:cc|creative commons) attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
]

_END = r"(?: (?:public )?licen[sc]e)?(?: agreement)?"
#: How a text speaks of a licence: name of the frame, priority, pattern around the licence's own.
FRAMES = [
    ("grant", 1, r"(?:dual |re ?)?(?:licen[sc]ed|released|distributed|available|provided|published|offered|redistributed|covered|shared)(?: to you)?(?: only)? under(?: the)?(?: (?:terms|conditions|terms and conditions)(?: of)?)? ", _END),
    ("under", 1, r"(?:under|subject to|according to|governed by)(?: the)?(?: (?:terms|conditions|provisions|terms and conditions) of)? ", r"(?: (?:public )?licen[sc]e)"),
    ("name", 3, r"", r" (?:public )?(?:licen[sc]e|licen[sc]ed)"),
]
_IDENTIFIER = r"spdx licen[sc]e identifier (?:\S+ (?:and|or|with) )?"

#: Licence texts, addresses and hints: name, label, keyword, priority, pattern.
OTHERS = [
    ("mit-grant", "mit", "hereby granted", 2, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "mit", "permission notice", 2, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc-grant", "isc", "hereby granted", 2, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-redistribution", "bsd", "redistribution", 2, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-endorse", "bsd-3-clause", "endorse", 2, r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-advertising", "bsd-4-clause", "advertising", 2, r"all advertising materials mentioning features or use of this software must display"),
    ("gpl-redistribute", "gpl", "redistribute", 2, r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-hope", "gpl", "will be useful", 2, r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl-received", "gpl", "received a copy", 2, r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[sc]e"),
    ("gpl-preamble", "gpl", "copyleft", 2, r"the gnu general public licen[sc]e is a free copyleft licen[sc]e"),
    ("apache-limitations", "apache-2", "limitations under", 2, r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-compliance", "apache-2", "in compliance", 2, r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-required", "apache-2", "applicable law", 2, r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("mpl-source", "mpl-2", "source code form", 2, r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("epl-made-available", "epl", "accompanying materials", 2, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("boost-grant", "bsl-1", "hereby granted", 2, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib-origin", "zlib", "misrepresented", 2, r"the origin of this software must not be misrepresented"),
    ("zlib-altered", "zlib", "altered source", 2, r"altered source versions must be plainly marked as such"),
    ("unlicense-text", "unlicense", "public domain", 2, r"this is free and unencumbered software released into the public domain"),
    ("cc0-waiver", "cc0-1", "waived", 2, r"has waived all copyright and related or neighboring rights"),
    ("ofl-reserved", "ofl-1.1", "reserved font", 2, r"with reserved font name"),
    ("artistic-package", "artistic", "standard version", 2, r"you may make and give away verbatim copies of the source form of the standard version"),
    ("wtfpl-text", "wtfpl", "you just do", 2, r"you just do what the f\S+ you want to"),
    ("cc-url-by", "cc-by", "creativecommons", 1, r"creativecommons org licen[sc]es by [1-4] [05]"),
    ("cc-url-by-sa", "cc-by-sa", "creativecommons", 1, r"creativecommons org licen[sc]es by sa [1-4] [05]"),
    ("cc-url-by-nc", "cc-by-nc", "creativecommons", 1, r"creativecommons org licen[sc]es by nc [1-4] [05]"),
    ("cc-url-by-nd", "cc-by-nd", "creativecommons", 1, r"creativecommons org licen[sc]es by nd [1-4] [05]"),
    ("cc-url-by-nc-sa", "cc-by-nc-sa", "creativecommons", 1, r"creativecommons org licen[sc]es by nc sa [1-4] [05]"),
    ("cc-url-by-nc-nd", "cc-by-nc-nd", "creativecommons", 1, r"creativecommons org licen[sc]es by nc nd [1-4] [05]"),
    ("cc-url-zero", "cc0-1", "creativecommons", 1, r"creativecommons org publicdomain zero 1 0"),
    ("apache-url", "apache-2", "apache org", 1, r"apache org licen[sc]es licen[sc]e 2 0"),
    ("mit-url", "mit", "opensource org", 1, r"opensource org licen[sc]es mit"),
    ("bsd-url", "bsd", "opensource org", 1, r"opensource org licen[sc]es bsd \d clause"),
    ("gnu-url", "gpl", "gnu org", 1, r"gnu org licen[sc]es(?: old licenses)?(?: [al]?gpl(?: \d \d)?)?"),
    ("mpl-url", "mpl", "mozilla org", 1, r"mozilla org mpl(?: 2 0)?"),
    ("epl-url", "epl", "eclipse org", 1, r"eclipse org legal epl v?\d+"),
    ("unlicense-url", "unlicense", "unlicense org", 1, r"unlicense org"),
    ("cc-bare-by-nc", "cc-by-nc", "cc by nc", 3, r"cc by nc(?: [1-4] [05])?"),
    ("cc-bare-by-sa", "cc-by-sa", "cc by sa", 3, r"cc by sa(?: [1-4] [05])?"),
    ("cc-bare-by-nd", "cc-by-nd", "cc by nd", 3, r"cc by nd(?: [1-4] [05])?"),
    ("cc-bare-by", "cc-by", "cc by", 3, r"cc by [1-4] [05]"),
    ("gpl-any", "gpl", "general public", 4, r"(?:gnu )?general public licen[sc]e"),
    ("lgpl-any", "lgpl", "general public", 4, r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("agpl-any", "agpl", "affero", 4, r"(?:gnu )?affero general public licen[sc]e"),
    ("apache-any", "apache", "apache", 4, r"apache(?: software)? licen[sc]e"),
    ("bsd-any", "bsd", "bsd", 4, r"bsd(?: style)? licen[sc]e"),
    ("mpl-any", "mpl", "mozilla", 4, r"mozilla public licen[sc]e"),
    ("epl-any", "epl", "eclipse", 4, r"eclipse public licen[sc]e"),
    ("cc-any", "creative-commons", "creative commons", 4, r"(?:a )?creative commons(?: licen[sc]e)?"),
    ("public-domain", "public-domain", "public domain", 4, r"(?:dedicated to|released into|placed in|in) the public domain"),
    ("proprietary-rights", "all-rights-reserved", "rights reserved", 4, r"all rights reserved"),
    ("proprietary", "proprietary", "proprietary", 4, r"(?:proprietary and confidential|proprietary licen[sc]e)"),
    ("proprietary-commercial", "proprietary", "commercial", 4, r"commercial licen[sc]e required"),
    ("non-commercial", "non-commercial", "commercial", 4, r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("as-is", "warranty-disclaimer", "as is", 4, r"(?:is )?provided (?:by \S+(?: \S+){0,8} )?as is(?: and any express or implied warranties| without warranty of any kind)"),
    ("see-licence-file", "see-licence-file", "licen", 4, r"see (?:the )?(?:file )?licen[sc]e(?: file)?(?: txt| md)? for (?:details|more information|licen[sc]e information)"),
]


def rules() -> list[Rule]:
    """All rules in order: about 360, each name in each frame, each identifier, and the rules of their own."""
    found = []
    for label, keyword, name, identifier in LICENCES:
        versioned = any(c.isdigit() for c in label)  # "under the gnu gpl version 3" needs no further word
        named = [(label, keyword, name)] + [(f"{label}/{alias}", word, other) for of, alias, word, other in ALIASES if of == label]
        for called, word, pattern in named:
            for frame, priority, before, after in FRAMES:
                after = f"{after}?" if frame == "under" and versioned else after
                found.append(Rule(f"{called}/{frame}", label, word, priority, f"{before}(?:{pattern}){after}"))
        found.append(Rule(f"{label}/identifier", label, "spdx", 1, f"{_IDENTIFIER}{identifier}"))
    found += [Rule(name, label, keyword, priority, pattern) for name, label, keyword, priority, pattern in OTHERS]
    return found


#: Any text that a rule can match holds one of these.
ANCHORS = ["licen", " under ", "subject to", "according to", "governed by", "cc by", "creative", "public domain", "rights reserved", "hereby granted", "copyright", "redistribut", "software", "opensource org", "mozilla org", "eclipse org", "commercial", "proprietary", "warrant", "reserved font", "altered source", "accompanying materials", "standard version", "you just do", "endorse or promote", "advertising materials"]
