"""License notices by ordered signature rules.

A rule is a regular expression with a label, a priority and a keyword. Texts
without any keyword are passed over; in the others only rules whose keyword is
there are tried. Detections overlap (a notice holds a name, a name holds a
family, a text its clauses): one that lies inside another's interval is suppressed if the other's
priority is higher, or equal with a longer interval.

The base phrases are places where words stand one after the other; a word is a
run of ASCII letters and digits and of all other non-ASCII characters. Rules and
phrases ignore the case of A-Z only. Everything runs on built-in functions, in
one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.spans import SPAN, find_all

_W = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_S = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = _W + "+"
#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licenses: label, keyword (lower case), pattern of the name, pattern of the usual identifier.
LICENSES = (
    ("mit", "mit", r"mit", r"mit"),
    ("mit-0", "mit", r"mit\W+no\W+attribution", r"mit-0"),
    ("apache-1.1", "apache", r"apache\W+(?:software\W+)?licen[sc]e,?\W+(?:version\W+|v\.?\W*)?1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache", r"apache\W+(?:software\W+)?licen[sc]e,?\W+(?:version\W+|v\.?\W*)?2(?:\.0)?", r"apache-2\.0"),
    ("apache", "apache", r"apache(?:\W+software)?", r"apache"),
    ("gpl-1.0", "general public", r"(?:gnu\W+)?general\W+public\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?"),
    ("gpl-2.0", "general public", r"(?:gnu\W+)?general\W+public\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "general public", r"(?:gnu\W+)?general\W+public\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("gpl", "general public", r"(?:gnu\W+)?general\W+public", r"gpl"),
    ("lgpl-2.0", "public", r"(?:gnu\W+)?library\W+general\W+public\W+licen[sc]e", r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu\W+)?lesser\W+general\W+public\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu\W+)?lesser\W+general\W+public\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("lgpl", "lesser", r"(?:gnu\W+)?lesser\W+general\W+public", r"lgpl"),
    ("agpl-3.0", "affero", r"(?:gnu\W+)?affero\W+general\W+public", r"agpl-3\.0(?:-only|-or-later|\+)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd\W+2\W*clause|simplified\W+bsd|freebsd)", r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd\W+3\W*clause|(?:new|modified|revised)\W+bsd)", r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd\W+4\W*clause|original\W+bsd)", r"bsd-4-clause"),
    ("bsd", "bsd", r"bsd", r"bsd"),
    ("mpl-1.1", "mozilla", r"mozilla\W+public\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla\W+public\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?2(?:\.0)?", r"mpl-2\.0"),
    ("mpl", "mozilla", r"mozilla\W+public", r"mpl"),
    ("epl-1.0", "eclipse", r"eclipse\W+public\W+licen[sc]e,?\W+(?:-\W*)?(?:version\W+|v\.?\W*)?1(?:\.0)?", r"epl-1\.0"),
    ("epl-2.0", "eclipse", r"eclipse\W+public\W+licen[sc]e,?\W+(?:-\W*)?(?:version\W+|v\.?\W*)?2(?:\.0)?", r"epl-2\.0"),
    ("epl", "eclipse", r"eclipse\W+public", r"epl"),
    ("cddl-1.0", "common development", r"common\W+development\W+and\W+distribution", r"cddl-1\.[01]"),
    ("cpl-1.0", "common public", r"common\W+public", r"cpl-1\.0"),
    ("eupl-1.2", "european union", r"european\W+union\W+public", r"eupl-1\.[12]"),
    ("isc", "isc", r"isc", r"isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib"),
    ("bsl-1.0", "boost", r"boost\W+software", r"bsl-1\.0"),
    ("artistic-1.0", "artistic", r"artistic\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?1(?:\.0)?", r"artistic-1\.0"),
    ("artistic-2.0", "artistic", r"artistic\W+licen[sc]e,?\W+(?:version\W+|v\.?\W*)?2(?:\.0)?", r"artistic-2\.0"),
    ("artistic", "artistic", r"artistic", r"artistic"),
    ("cc0-1.0", "cc0", r"cc0", r"cc0-1\.0"),
    ("cc-by-4.0", "creative commons", r"creative\W+commons\W+attribution(?:\W+4\.0)?(?:\W+international)?", r"cc-by-[1-4]\.[05]"),
    ("cc-by-sa-4.0", "creative commons", r"creative\W+commons\W+attribution\W+share\W*alike(?:\W+4\.0)?(?:\W+international)?", r"cc-by-sa-[1-4]\.[05]"),
    ("cc-by-nc-4.0", "creative commons", r"creative\W+commons\W+attribution\W+non\W*commercial(?:\W+4\.0)?(?:\W+international)?", r"cc-by-nc-[1-4]\.[05]"),
    ("cc-by-nd-4.0", "creative commons", r"creative\W+commons\W+attribution\W+no\W*deriv(?:ative)?s?(?:\W+4\.0)?(?:\W+international)?", r"cc-by-nd-[1-4]\.[05]"),
    ("unlicense", "unlicense", r"(?:the\W+)?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("ms-pl", "microsoft public", r"microsoft\W+public", r"ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft\W+reciprocal", r"ms-rl"),
    ("ofl-1.1", "open font", r"(?:sil\W+)?open\W+font", r"ofl-1\.[01]"),
    ("odbl-1.0", "open database", r"open\W+database", r"odbl-1\.0"),
    ("python-2.0", "python software", r"python\W+software\W+foundation", r"(?:python|psf)-2\.0"),
    ("php-3.01", "php", r"php", r"php-3\.0[01]?"),
    ("ruby", "ruby", r"ruby", r"ruby"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university\W+of\W+illinois/?)?ncsa(?:\W+open\W+source)?", r"ncsa"),
    ("afl-3.0", "academic free", r"academic\W+free", r"afl-[1-3]\.[0-2]"),
    ("osl-3.0", "open software", r"open\W+software", r"osl-[1-3]\.[0-1]"),
    ("upl-1.0", "universal permissive", r"universal\W+permissive", r"upl-1\.0"),
    ("blueoak-1.0.0", "blue oak", r"blue\W+oak\W+model", r"blueoak-1\.0\.0"),
    ("bsl-1.1", "business source", r"business\W+source", r"busl-1\.1"),
    ("sspl-1.0", "server side public", r"server\W+side\W+public", r"sspl-1\.0"),
    ("elastic-2.0", "elastic", r"elastic", r"elastic-2\.0"),
)


def _short(name: str, version: str) -> str:
    """Pattern of a short name with a version: GPLv3, GPL-3.0-or-later, GPL version 3."""
    number = version.replace(".", r"\.")
    if version.endswith(".0"):
        number = number[:-3] + r"(?:\.0)?"
    return rf"{name}(?:\W*v(?:ersion)?\W*|\W+){number}(?:\+|\W?or\W?later|\W?only)?(?!\w|\.[0-9])"


_VERSIONS = {
    "gpl": ("1.0", "2.0", "3.0"),
    "lgpl": ("2.0", "2.1", "3.0"),
    "agpl": ("1.0", "3.0"),
    "mpl": ("1.0", "1.1", "2.0"),
    "epl": ("1.0", "2.0"),
    "cddl": ("1.0", "1.1"),
    "cpl": ("1.0",),
    "eupl": ("1.1", "1.2"),
    "ofl": ("1.0", "1.1"),
    "afl": ("1.1", "1.2", "2.0", "2.1", "3.0"),
    "osl": ("1.0", "1.1", "2.0", "2.1", "3.0"),
    "upl": ("1.0",),
    "odbl": ("1.0",),
    "bsl": ("1.0", "1.1"),
    "sspl": ("1.0",),
    "apache": ("1.1", "2.0"),
    "artistic": ("1.0", "2.0"),
}
_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
#: Usual short names: label, keyword, pattern.
SHORT = (
    *[(f"{n}-{v}", n, _short(n, v)) for n, versions in _VERSIONS.items() for v in versions],
    *[(n, n, rf"{n}(?!\w)") for n in _VERSIONS if n not in ("apache", "artistic", "bsl")],
    *[(f"cc-{k}-{v}", f"cc {k} {v}", rf"cc\W+{k.replace('-', chr(92) + 'W+')}\W+{v.replace('.', chr(92) + '.')}(?!\w|\.[0-9])") for k in _KINDS for v in ("1.0", "2.0", "2.5", "3.0", "4.0")],
    *[(f"cc-{k}", f"cc {k}", rf"cc\W+{k.replace('-', chr(92) + 'W+')}(?!\w)") for k in _KINDS],
    ("bsd-2-clause", "clause bsd", r"(?:2|two)\W+clause\W+bsd"),
    ("bsd-3-clause", "clause bsd", r"(?:3|three)\W+clause\W+bsd"),
    ("bsd-4-clause", "clause bsd", r"(?:4|four)\W+clause\W+bsd"),
    ("cc0-1.0", "cc0", r"cc0(?:\W+1\.0)?(?!\w)"),
    ("ms-pl", "ms pl", r"ms-pl(?!\w)"),
    ("ms-rl", "ms rl", r"ms-rl(?!\w)"),
)
#: How a short name stands in a notice: pattern, priority.
SHORT_FORMS = (
    (r"(?:(?:licen[sc]ed|released|distributed|available|provided|published|covered)\W+)?under\W+(?:an?\W+|the\W+)?(?:terms\W+of\W+)?(?:the\W+)?{name}(?:\W+licen[sc]e)?", 80),
    (r"{name}\W+licen[sc]ed?(?!\w)", 60),
    (r"licen[sc]e\W*[:=]\W*{name}", 50),
)
#: Notices without a name of their own: label, keyword, pattern, priority.
NOTICES = (
    ("mit", "permission is hereby granted", r"permission\W+is\W+hereby\W+granted,?\W+free\W+of\W+charge,?\W+to\W+any\W+person\W+obtaining\W+a\W+copy", 90),
    ("isc", "permission to use", r"permission\W+to\W+use,\W+copy,\W+modify,?\W+and(?:/or)?\W+distribute\W+this\W+software", 90),
    ("bsd", "redistribution and use", r"redistribution\W+and\W+use\W+in\W+source\W+and\W+binary\W+forms", 90),
    ("bsd-3-clause", "endorse or promote", r"may\W+be\W+used\W+to\W+endorse\W+or\W+promote\W+products", 90),
    ("gpl", "free software", r"this\W+program\W+is\W+free\W+software", 85),
    ("zlib", "as-is", r"this\W+software\W+is\W+provided\W+'as-is',\W+without\W+any\W+express\W+or\W+implied\W+warranty", 90),
    ("public-domain", "public domain", r"(?:placed|released|dedicated)\W+(?:in|into|to)\W+the\W+public\W+domain", 80),
    ("public-domain", "unencumbered", r"this\W+is\W+free\W+and\W+unencumbered\W+software", 90),
    ("proprietary", "all rights reserved", r"all\W+rights\W+reserved", 20),
    ("proprietary", "confidential", r"proprietary\W+and\W+confidential", 60),
)
#: Clauses by which a license text is known even without its name: label, words, priority. Any white space,
#: comment marks and punctuation may part the words; two words may stand for one as (a|b).
CLAUSES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 95),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 92),
    ("mit", "the above copyright notice and this permission notice (shall|must) be included in all copies or substantial portions of the software", 90),
    ("mit", "the software is provided as is without warranty of any kind express or implied", 60),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 60),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", 95),
    ("x11", "except as contained in this notice the name of the copyright holder shall not be used in advertising or otherwise to promote the sale", 92),
    ("mit-cmu", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 92),
    ("hpnd", "appear in supporting documentation and that the name of the copyright holder not be used in advertising or publicity", 90),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 95),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", 88),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 96),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 92),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 90),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 90),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", 88),
    ("bsd", "in no event shall the copyright (holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages", 86),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", 95),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission", 94),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 96),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", 95),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 96),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", 95),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", 70),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 90),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 90),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 92),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products", 94),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license", 92),
    ("gpl-2.0", "either version 2 of the license or at your option any later version", 93),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", 93),
    ("gpl-2.0", "under the terms of the gnu general public license version 2 as published by the free software foundation", 95),
    ("gpl", "see the gnu general public license for more details", 80),
    ("gpl", "you should have received a copy of the gnu general public license along with", 84),
    ("gpl-2.0", "foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa", 78),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it", 95),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", 95),
    ("gpl-3.0", "the licenses for most software and other practical works are designed to take away your freedom to share", 95),
    ("gpl-1.0", "the license agreements of most software companies try to keep users at the mercy of those companies", 95),
    ("lgpl", "under the terms of the gnu (lesser|library) general public license as published by the free software foundation", 93),
    ("lgpl-2.1", "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license", 95),
    ("lgpl-2.0", "this license the library general public license applies to some specially designated free software foundation software", 95),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 95),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 96),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation", 95),
    ("agpl-3.0", "remote network interaction use with the gnu general public license", 92),
    ("gpl-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library", 90),
    ("gpl-classpath-exception", "give you permission to link this library with independent modules to produce an executable", 92),
    ("gpl-gcc-exception", "you have permission to propagate a work of target code formed by combining the runtime library with independent modules", 92),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 95),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts a copy of the license", 90),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 96),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at the license page", 92),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 96),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights", 88),
    ("npl-1.1", "the contents of this file are subject to the netscape public license version 1 1", 96),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license", 90),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 96),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 96),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", 94),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license", 94),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 95),
    ("cddl-1.0", "when distributing covered code include this cddl header in each file and include the license file", 93),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission", 95),
    ("eupl-1.1", "licensed under the eupl version 1 1 or as soon they will be approved by the european commission", 95),
    ("cecill-2.1", "this software is governed by the cecill license under french law and abiding by the rules of distribution of free software", 95),
    ("cecill-b", "this software is governed by the cecill b license under french law", 95),
    ("cecill-c", "this software is governed by the cecill c license under french law", 95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 94),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 92),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 92),
    ("libpng", "this code is released under the libpng license", 94),
    ("bsl-1.0", "distributed under the boost software license version 1 0", 95),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 95),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", 92),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 95),
    ("perl", "you can redistribute it and or modify it under the same terms as perl itself this license", 90),
    ("python-2.0", "psf is making python available to licensee on an as is basis", 94),
    ("python-2.0", "this license agreement is between the python software foundation", 94),
    ("php-3.01", "this product includes php software freely available from", 92),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", 92),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 95),
    ("ssleay", "this product includes cryptographic software written by eric young", 94),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 95),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 96),
    ("ncsa", "may be used to endorse or promote products derived from this software without specific prior written permission nor the names of its developers", 90),
    ("w3c", "permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted", 95),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 95),
    ("icu", "provided that the above copyright notice s and this permission notice appear in all copies of the software", 90),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 95),
    ("libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 94),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 94),
    ("freetype", "portions of this software are copyright the freetype project", 92),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", 94),
    ("json", "the software shall be used for good not evil", 96),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this license", 94),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 95),
    ("unlicense", "this is free and unencumbered software released into the public domain", 96),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 92),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", 95),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", 95),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 94),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", 95),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", 95),
    ("cc-by-sa-3.0", "text is available under the creative commons attribution sharealike license", 92),
    ("cc-by", "creative commons corporation is not a law firm and does not provide legal services or legal advice under this license", 80),
    ("public-domain", "this (work|software|file) is in the public domain", 88),
    ("public-domain", "no copyright is claimed and the work is dedicated to the public domain", 88),
    ("public-domain", "the author disclaims copyright to this source code in place of a legal notice here is a blessing", 94),
    ("us-government", "this software is a work of the united states government and is not subject to copyright protection", 90),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software", 88),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 96),
    ("ofl-1.1", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces", 88),
    ("bitstream-vera", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license", 94),
    ("odbl-1.0", "made available under the open database license", 92),
    ("odc-by-1.0", "made available under the open data commons attribution license", 94),
    ("pddl-1.0", "made available under the public domain dedication and license", 94),
    ("afl-3.0", "licensed under the academic free license version 3 0", 95),
    ("osl-3.0", "licensed under the open software license version 3 0", 95),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", 92),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 95),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service under this license", 92),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", 95),
    ("commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 95),
    ("polyform-nc", "any noncommercial purpose is a permitted purpose the software", 88),
    ("proprietary", "no part of this (publication|software|document) may be reproduced without the prior written permission", 80),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", 90),
    ("proprietary", "this software is the confidential and proprietary information of", 90),
    ("proprietary", "licensed for personal and non commercial use only", 70),
    ("eula", "by installing or using the software you agree to be bound by the terms of this license agreement", 85),
)
#: How a license is named in a notice: pattern around the name, priority.
FORMS = (
    (r"(?:licen[sc]ed|released|distributed|available|provided|published|covered)\W+under\W+(?:the\W+)?(?:terms\W+of\W+)?(?:the\W+)?{name}(?:\W+licen[sc]e)?", 80),
    (r"{name}\W+licen[sc]e(?:\W+(?:agreement|version\W+[0-9]+(?:\.[0-9]+)*))?", 60),
    (r"licen[sc]e\W*[:=]\W*{name}(?!\w)", 50),
    (r"spdx-license-identifier:\x20*{id}(?![\w.-])", 100),
)


def rules() -> list[tuple[str, str, str, int]]:
    """All rules as label, keyword, pattern, priority: each license in each form, then the notices."""
    out = []
    for label, keyword, name, identifier in LICENSES:
        for form, priority in FORMS:
            by_id = "{id}" in form
            pattern = form.replace("{name}", f"(?:{name})").replace("{id}", f"(?:{identifier})")
            # A version says more than a family.
            out.append((label, "spdx-license-identifier" if by_id else keyword, rf"(?i)(?<!\w){pattern}", priority + (5 if label[-1].isdigit() else 0)))
        # A name that says "license" itself stands alone.
        if "licen" in name:
            out.append((label, keyword, rf"(?i)(?<!\w)(?:{name})(?!\w|\.[0-9])", 65 if label[-1].isdigit() else 60))
    for label, keyword, name in SHORT:
        for form, priority in SHORT_FORMS:
            out.append((label, keyword, rf"(?i)(?<!\w){form.replace('{name}', f'(?:{name})')}", priority + (5 if re.search(r"\.[0-9]$", label) or label[-1].isdigit() else 0)))
    for label, words, priority in CLAUSES:
        plain = words.split()
        # The words up to the first choice are the keyword: as good as the rule itself.
        fixed = plain[: next((k for k, w in enumerate(plain) if "(" in w), len(plain))]
        out.append((label, " ".join(fixed), r"(?i)(?<!\w)" + r"\W+".join(w.replace("(", "(?:") for w in plain) + r"(?!\w)", priority))
    return out + [(label, keyword, rf"(?i)(?<!\w){pattern}", priority) for label, keyword, pattern, priority in NOTICES]


#: Every match of a rule holds one of these, or what ``_UNDER`` finds.
GATE = ("licen", "permission", "redistribution", "endorse", "software", "as-is", "domain", "unencumbered", "reserved", "confidential", "copyright", "warrant", "conditions", "foundation", "advertising", "library")
_STEMS = "|".join(sorted({k.split()[0] for _, k, _ in SHORT} | {"[234]", "two", "three", "four"}))
_UNDER = rf"[de]\W+under|(?<!\w)under\W+(?:an?\W+|the\W+)?(?:terms\W+of\W+)?(?:the\W+)?(?:{_STEMS})"
_PHRASE = rf"(?i)(?<!{_W})(?:" + "|".join(rf"{_S}++".join(p.split()) for p in PHRASES) + rf")(?!{_W})"
_DETECTION = "array<struct<start:int,end:int,label:string,priority:int>>"


def detections(text: Column, low: Column) -> Column:
    """All matches of all rules whose keyword a text (``low``: lower-cased) holds, whatever parts its words."""
    table = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(re.sub(r"\W+", " ", k)).alias("keyword"), F.lit(p).alias("pattern"), F.lit(n).alias("priority")) for a, k, p, n in rules()])
    tried = F.element_at(F.transform(F.array(F.regexp_replace(low, r"\W+", " ")), lambda x: F.filter(table, lambda r: F.contains(x, r["keyword"]))), 1)
    return F.flatten(F.transform(tried, lambda r: F.transform(find_all(text, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority")))))


def suppress(found: Column) -> Column:
    """Detections (a column, not an expression) without those another one contains and beats, by place."""

    def stands(d: Column) -> Column:
        def beats(o: Column) -> Column:
            inside = (o["start"] <= d["start"]) & (d["end"] <= o["end"])
            longer = o["end"] - o["start"] > d["end"] - d["start"]
            return inside & ((o["priority"] > d["priority"]) | ((o["priority"] == d["priority"]) & longer))

        return ~F.exists(found, beats)

    return F.array_sort(F.filter(found, stands))


def find_licenses(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all), n_words, phrases, first_word, last_word, detections.

    ``phrases`` are the base phrases (start, end, match), ``first_word`` and
    ``last_word`` the words the first and last begin at (null without any), and
    ``detections`` what the rules leave (start, end, label, priority); other
    places are in characters. A null text counts as empty; rows are judged each
    for itself; an empty table stays empty. Columns with these names are replaced.
    """
    new = ("n_words", "phrases", "first_word", "last_word", "detections")
    names = [c for c in (documents.columns if keep is None else keep) if c not in new]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    text, low = F.col("text"), F.col("low")
    gate = F.contains(low, F.lit("under")) & low.rlike(_UNDER)
    for word in GATE:
        gate = gate | F.contains(low, F.lit(word))
    phrases = F.when(F.contains(low, F.lit("license")), find_all(text, _PHRASE)).otherwise(F.array().cast(SPAN))
    found = F.when(gate, detections(text, low)).otherwise(F.array().cast(_DETECTION))
    rows = rows.select("row", "text", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), phrases.alias("phrases"), found.alias("detections"))

    def word_at(k: int) -> Column:
        head = F.substring("text", F.lit(1), F.element_at("phrases", k)["start"])
        return F.when(F.size("phrases") > 0, F.regexp_count(head, F.lit(WORD)).cast("long"))

    kept = F.when(F.size("detections") > 1, suppress(F.col("detections"))).otherwise(F.col("detections"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], "n_words", "phrases", word_at(1).alias("first_word"), word_at(-1).alias("last_word"), kept.alias("detections"))


def license_report(documents: DataFrame) -> DataFrame:
    """Base phrases and labels of all documents (query ``op6``)."""
    found = find_licenses(documents, keep=["doc_id"])
    label = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    base = F.transform("phrases", lambda s: label[F.regexp_replace(F.lower(s["match"]), rf"{_S}+", " ")])
    found = found.withColumn("base", F.array_sort(F.array_distinct(base)))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / F.lit(105.0)
    score = F.greatest(F.when(F.size("base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)), best)
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
