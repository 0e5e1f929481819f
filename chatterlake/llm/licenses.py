"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Texts are read as words: A-Z in lower case, runs of digits, a-z and characters beyond ASCII. Rules are patterns over the
words joined by spaces: signatures written one by one, of license bodies, headers, file notes and terms, and the names of
license families in the phrases that grant or cite a license. A rule is tried only on texts that hold its keyword. A
detection that lies wholly inside one of the same or a better priority is suppressed, as "cc by" inside "cc by nc".

Defined results: null text has no words and no detections; equal rows give equal results, rows are never joined; an
empty table gives an empty result; columns other than the text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Fixed phrases that always count, with their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

V = r"(?: (?:version|v))?"
#: Label, keyword, the family's name as a pattern over words. Longer names stand before shorter ones.
FAMILIES = (
    ("agpl-3", "affero", rf"(?:gnu )?affero general public licen[cs]e{V} 3(?: 0)?(?: (?:or later|only))?"),
    ("agpl-3", "agpl", rf"agpl{V} ?v?3(?: 0)?(?: (?:or later|only))?"),
    ("lgpl-2.1", "lgpl", rf"lgpl{V} ?v?2 1(?: (?:or later|only))?"),
    ("lgpl-3", "lgpl", rf"lgpl{V} ?v?3(?: 0)?(?: (?:or later|only))?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{V} 2 1(?: (?:or later|only))?"),
    ("lgpl-3", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{V} 3(?: 0)?(?: (?:or later|only))?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("gpl-2", "gpl", rf"(?:gnu )?gpl{V} ?v?2(?: 0)?(?: (?:or later|only))?"),
    ("gpl-3", "gpl", rf"(?:gnu )?gpl{V} ?v?3(?: 0)?(?: (?:or later|only))?"),
    ("gpl-2", "general", rf"(?:gnu )?general public licen[cs]e{V} 2(?: 0)?(?: (?:or later|only))?"),
    ("gpl-3", "general", rf"(?:gnu )?general public licen[cs]e{V} 3(?: 0)?(?: (?:or later|only))?"),
    ("gpl", "gnu", r"gnu general public licen[cs]e"),
    ("gfdl", "documentation", rf"(?:gnu )?free documentation licen[cs]e(?:{V} 1 [123])?"),
    ("apache-2", "apache", rf"apache(?: software)?(?: licen[cs]e)?{V} 2(?: 0)?(?: licen[cs]e)?"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[cs]e{V} 1 1"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit", "mit", r"mit(?: x11| style)? licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{V} 1 1"),
    ("mpl-2", "mozilla", rf"mozilla public licen[cs]e{V} 2(?: 0)?"),
    ("mpl-2", "mpl", rf"mpl{V} ?2(?: 0)?"),
    ("epl-2", "eclipse", rf"eclipse public licen[cs]e{V} 2(?: 0)?"),
    ("epl-1", "eclipse", rf"eclipse public licen[cs]e{V} 1(?: 0)?"),
    ("cddl-1", "cddl", rf"cddl{V} 1(?: [01])?"),
    ("cddl-1", "development", rf"common development and distribution licen[cs]e(?:{V} 1 [01])?"),
    ("eupl", "eupl", rf"eupl(?:{V} 1 [0-2])?"),
    ("artistic-2", "artistic", rf"artistic licen[cs]e{V} 2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", rf"boost software licen[cs]e(?:{V} 1(?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "commons", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc", "commons", r"creative commons licen[cs]e"),
    ("python-2", "python", r"python software foundation licen[cs]e(?: (?:version )?2)?"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ofl-1.1", "sil", r"sil open font licen[cs]e(?: (?:version )?1 1)?"),
    ("odbl", "database", r"open database licen[cs]e"),
)
#: Ways to name a license, as patterns around the family's name, with priority (lower first) and confidence.
PHRASES = (
    (r"spdx licen[cs]e identifier {name}", 0, 1.0),
    (r"(?:licen[cs]ed|released|distributed|published|available|provided|dual licen[cs]ed|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:a )?{name}(?: licen[cs]e)?", 1, 0.95),
    (r"(?:subject to|governed by|covered by|in accordance with|pursuant to|according to|may be used under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[cs]e)?", 2, 0.9),
    (r"(?:terms|copy|text|conditions) of (?:the )?{name}(?: licen[cs]e)?", 3, 0.85),
    (r"(?:licen[cs]e|licen[cs]es|licen[cs]ing) (?:is |are )?(?:the )?{name}", 4, 0.8),
    (r"{name}", 5, 0.6),
)
#: Signatures written one by one: bodies and headers of licenses, tags, file notes and notices: label, keyword, pattern,
#: priority, confidence. Every match holds the keyword, or one of the keywords, as a word.
SIGNATURES = (
    # bodies and headers of permissive licenses
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 2, 0.85),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 1, 0.9),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?", 1, 0.9),
    ("mit-advertising", "advertising", r"except as contained in this notice the name of .{1,80}? shall not be used in advertising or otherwise to promote", 2, 0.8),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 1, 0.9),
    ("0bsd", "0bsd|bsd", r"(?:zero clause bsd|0bsd)(?: licen[cs]e)?", 1, 0.9),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose", 1, 0.85),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1, 0.9),
    ("bsd-2-clause", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.85),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,80}? nor the names of (?:its|their|other) contributors may be used to endorse or promote products", 1, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", 1, 0.9),
    ("bsd-patent", "patent", r"bsd(?: 2 clause)? plus patent(?: licen[cs]e)?", 1, 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 0.95),
    ("boost", "processor", r"executable object code generated by a source language processor", 2, 0.8),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance", 0, 1.0),
    ("apache-2", "conditions", r"terms and conditions for use reproduction and distribution 1 definitions", 1, 0.9),
    ("apache-2", "warranties", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", 2, 0.85),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 1, 0.85),
    ("apache-2", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements", 0, 0.95),
    ("python-2", "psf", r"psf is making python available to licensee on an as is basis", 1, 0.95),
    ("python-2", "psf", r"psf license agreement for python 2", 1, 0.95),
    ("postgresql", "postgresql", r"postgresql is released under the postgresql license", 0, 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 1, 0.9),
    ("ssleay", "library", r"this library is free for commercial and non commercial use as long as the following conditions are adhered to", 1, 0.8),
    ("curl", "curl", r"curl and libcurl are (?:licensed|true open source)", 1, 0.8),
    ("icu", "unicode", r"unicode(?: inc)? licen[cs]e agreement(?: data files and software)?", 1, 0.9),
    ("unicode-3", "unicode", r"unicode licen[cs]e v3", 1, 0.9),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[cs]e", 1, 0.95),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e", 1, 0.9),
    ("afl-3", "academic", r"academic free licen[cs]e(?: (?:version )?(?:v )?(?:3 0|2 1|2 0))?", 1, 0.9),
    ("ecl-2", "educational", r"educational community licen[cs]e(?: version 2 0)?", 1, 0.9),
    ("upl-1", "universal", r"universal permissive licen[cs]e(?: v(?:ersion)? 1 0)?", 1, 0.9),
    ("bluoak-1", "blue", r"blue oak model licen[cs]e(?: 1 0 0)?", 1, 0.9),
    ("beerware", "beer|beerware", r"beer ?ware licen[cs]e(?: revision 42)?", 1, 0.9),
    ("beerware", "beer", r"you can buy me a beer in return", 1, 0.9),
    ("wtfpl", "want", r"do what the f ?u ?c ?k you want to public licen[cs]e", 1, 0.95),
    ("x11", "x11", r"x11 licen[cs]e(?: distribution modification variant)?", 1, 0.85),
    ("xfree86", "xfree86", r"xfree86(?: project)? licen[cs]e(?: 1 [01])?", 1, 0.85),
    ("libpng", "libpng|png", r"(?:png reference library|libpng) licen[cs]e(?: version 2)?", 1, 0.9),
    ("ijg", "jpeg", r"based in part on the work of the independent jpeg group", 1, 0.9),
    ("freetype", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e", 1, 0.9),
    ("php-3", "php", r"php licen[cs]e(?: version)? 3(?: 01?)?", 1, 0.9),
    ("ruby", "ruby", r"(?:under the same terms as ruby|ruby licen[cs]e)", 1, 0.8),
    ("perl", "perl", r"(?:under )?the same terms as perl(?: 5)? itself", 1, 0.9),
    ("tcl", "tcl", r"tcl tk licen[cs]e", 1, 0.85),
    ("vim", "vim", r"vim licen[cs]e", 1, 0.85),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: zpl)?(?: version 2 [01])?", 1, 0.9),
    ("sleepycat", "sleepycat", r"sleepycat(?: public| software)? licen[cs]e", 1, 0.9),
    ("mulan-2", "mulan", r"mulan (?:psl|permissive software licen[cs]e) v(?:ersion )?2", 1, 0.95),
    # bodies, headers and notes of copyleft licenses
    ("gpl-2", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 2", 0, 1.0),
    ("gpl-3", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3", 0, 1.0),
    ("lgpl-2.1", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1", 0, 1.0),
    ("lgpl-3", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3", 0, 1.0),
    ("agpl-3", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3", 0, 1.0),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with this (?:program|software|library|file)", 2, 0.85),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file)", 2, 0.85),
    ("gpl", "copying", r"see the file copying(?: 3)? for (?:copying conditions|details|the full license)", 3, 0.6),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 1, 0.95),
    ("gpl-2", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 1, 0.9),
    ("agpl-3", "network", r"your modified version must prominently offer all users interacting with it remotely through a computer network", 1, 0.95),
    ("lgpl-2.1", "library", r"gnu library general public licen[cs]e(?: version 2(?: 0)?)?", 1, 0.9),
    ("gpl-classpath", "classpath", r"(?:gpl|general public license)(?: version 2)? with (?:the )?classpath exception", 0, 0.95),
    ("gpl-classpath", "exception", r"as a special exception the copyright holders of this library give you permission to link this library", 1, 0.9),
    ("gcc-exception", "runtime", r"gcc runtime library exception(?: version 3 1)?", 1, 0.9),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 1, 0.95),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0, 1.0),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 1, 0.95),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 0, 1.0),
    ("npl-1.1", "netscape", r"netscape public licen[cs]e(?: version 1 [01])?", 1, 0.9),
    ("epl-1", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license v ?1 0", 0, 1.0),
    ("epl-2", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license(?: v ?| version )2 0", 0, 1.0),
    ("cpl-1", "common", r"common public licen[cs]e(?: (?:version |v )?1 0)?", 1, 0.9),
    ("ipl-1", "ibm", r"ibm public licen[cs]e(?: version 1 0)?", 1, 0.9),
    ("cddl-1", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license", 0, 0.95),
    ("eupl", "european", r"european union public licen[cs]e(?: v(?:ersion)? ?1 [0-2])?", 1, 0.95),
    ("cecill-2.1", "cecill", r"cecill(?: free software licen[cs]e)?(?: agreement)?(?: version)? 2 1", 1, 0.9),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: free software)? licen[cs]e", 2, 0.85),
    ("osl-3", "open", r"open software licen[cs]e(?: (?:version |v )?3 0)?", 2, 0.8),
    ("qpl-1", "q", r"q public licen[cs]e(?: version 1 0)?", 1, 0.9),
    ("apsl-2", "apple", r"apple public source licen[cs]e(?: version)?(?: 2 0)?", 1, 0.9),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e(?: ms pl)?", 1, 0.9),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e(?: ms rl)?", 1, 0.9),
    ("rpl-1.5", "reciprocal", r"reciprocal public licen[cs]e(?: version)?(?: 1 5)?", 1, 0.9),
    ("artistic", "package", r"this document states the conditions under which a package may be copied", 1, 0.8),
    # source-available and model licenses
    ("sspl-1", "server", r"server side public licen[cs]e(?: (?:version |v )?1)?", 1, 0.95),
    ("busl-1.1", "business", r"business source licen[cs]e(?: 1 1)?", 1, 0.95),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: (?:version |v )?2 0)?", 1, 0.9),
    ("commons-clause", "clause", r"commons clause(?: licen[cs]e condition)?", 2, 0.8),
    ("polyform-nc", "polyform", r"polyform noncommercial licen[cs]e(?: 1 0 0)?", 1, 0.95),
    ("polyform-small", "polyform", r"polyform small business licen[cs]e(?: 1 0 0)?", 1, 0.95),
    ("prosperity", "prosperity", r"prosperity public licen[cs]e(?: 3 0 0)?", 1, 0.9),
    ("parity-7", "parity", r"parity public licen[cs]e(?: 7 0 0)?", 1, 0.9),
    ("openrail-m", "rail|openrail|railm|openrailm", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: ?(?:\+\+ )?m)?(?: licen[cs]e)?", 1, 0.9),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e(?: (?:version )?[23] [01])?", 1, 0.9),
    # content and data licenses
    ("cc-by", "attribution", r"this work is licensed under a creative commons attribution(?: [1-4] 0)?(?: international| unported)? license", 0, 1.0),
    ("cc-by-sa", "attribution", r"this work is licensed under a creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)? license", 0, 1.0),
    ("cc-by-nc", "attribution", r"this work is licensed under a creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)? license", 0, 1.0),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?", 3, 0.8),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?", 2, 0.9),
    ("cc0", "waived", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", 1, 0.95),
    ("cc0", "commons", r"creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?", 2, 0.9),
    ("cc-pdm", "mark", r"public domain mark(?: 1 0)?", 2, 0.85),
    ("cc-sampling", "sampling", r"creative commons sampling plus(?: 1 0)?", 2, 0.85),
    ("fal-1.3", "art", r"free art licen[cs]e(?: 1 [23])?", 1, 0.85),
    ("fal-1.3", "art", r"licence art libre(?: 1 [23])?", 1, 0.85),
    ("odbl", "odbl", r"odbl(?: v?1 0)?", 3, 0.75),
    ("odc-by", "odc|commons", r"(?:odc by|open data commons attribution licen[cs]e)(?: v?1 0)?", 1, 0.9),
    ("pddl", "dedication", r"open data commons public domain dedication and licen[cs]e", 1, 0.9),
    ("cdla-permissive", "data", r"community data licen[cs]e agreement permissive(?: (?:version )?[12] 0)?", 1, 0.95),
    ("cdla-sharing", "data", r"community data licen[cs]e agreement sharing(?: (?:version )?1 0)?", 1, 0.95),
    ("ogl-uk", "government", r"open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?", 1, 0.9),
    ("etalab-2", "ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?", 1, 0.9),
    ("dl-de-by", "datenlizenz", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", 1, 0.95),
    ("dl-de-zero", "datenlizenz", r"datenlizenz deutschland zero(?: version)?(?: 2 0)?", 1, 0.95),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: version)? 1 1", 2, 0.85),
    ("ofl-1.1", "reserved", r"with reserved font names?", 3, 0.6),
    ("bitstream-vera", "bitstream", r"bitstream vera (?:fonts )?copyright", 1, 0.9),
    ("gfl", "gust", r"gust font licen[cs]e", 1, 0.9),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e(?: (?:version )?1 3c?)?", 1, 0.95),
    ("opl-1", "publication", r"open publication licen[cs]e(?: v(?:ersion)? ?1 0)?", 1, 0.9),
    # public domain
    ("public-domain", "domain", r"(?:released|dedicated|placed|is|are) (?:in|into|to) the public domain", 3, 0.8),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0, 1.0),
    ("us-government", "government", r"work of the (?:united states|us|u s) government(?: and is not subject to copyright)?", 2, 0.8),
    ("public-domain", "gemeinfrei", r"(?:ist|sind) gemeinfrei", 3, 0.7),
    ("public-domain", "domaine", r"(?:est|sont|appartient) (?:dans le|au) domaine public", 3, 0.7),
    ("public-domain", "dominio", r"(?:es|son|está|están) (?:de|en el) dominio público", 3, 0.7),
    # reserved rights, contracts and terms
    ("all-rights-reserved", "rights", r"all rights reserved", 3, 0.7),
    ("all-rights-reserved", "rights", r"all (?:other )?rights not expressly granted (?:herein )?are reserved", 3, 0.75),
    ("all-rights-reserved", "reproduced", r"no part of this (?:publication|book|work|document|website) may be reproduced", 2, 0.8),
    ("all-rights-reserved", "alle", r"alle rechte vorbehalten", 3, 0.7),
    ("all-rights-reserved", "nachdruck", r"nachdruck(?: auch auszugsweise)? (?:verboten|nur mit genehmigung)", 3, 0.7),
    ("all-rights-reserved", "tous", r"tous droits réservés", 3, 0.7),
    ("all-rights-reserved", "reproduction", r"toute reproduction(?: même partielle)? (?:est )?interdite", 3, 0.7),
    ("all-rights-reserved", "todos", r"todos los derechos reservados", 3, 0.7),
    ("all-rights-reserved", "prohibida", r"prohibida (?:su|la) reproducción(?: total o parcial)?", 3, 0.7),
    ("all-rights-reserved", "todos", r"todos os direitos reservados", 3, 0.7),
    ("all-rights-reserved", "tutti", r"tutti i diritti riservati", 3, 0.7),
    ("proprietary", "proprietary", r"(?:proprietary (?:and|or) confidential|confidential and proprietary)", 3, 0.7),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|document|work|software|material))?(?: via any medium)? is strictly prohibited", 2, 0.8),
    ("proprietary", "eula", r"end user licen[cs]e agreement eula", 2, 0.8),
    ("proprietary", "agreement", r"by installing or using (?:this|the) software you agree to (?:be bound by )?the terms of this agreement", 2, 0.8),
    ("non-commercial", "commercial|noncommercial", r"(?:for|licensed for) (?:personal and )?non ?commercial (?:use|purposes) only", 2, 0.75),
    ("research-only", "research", r"for (?:academic and )?research (?:use|purposes) only", 2, 0.75),
    ("evaluation", "evaluation", r"for evaluation (?:use|purposes) only", 2, 0.75),
    ("freeware", "freeware", r"(?:is|this) freeware", 3, 0.6),
    ("shareware", "shareware", r"(?:is|this) shareware", 3, 0.6),
    ("dual", "dual", r"dual licen[cs]ed under", 3, 0.6),
    # file notes
    ("see-license", "license", r"see (?:the )?license (?:file|txt|md)(?: in the project root)? for (?:license information|details|terms|more)", 3, 0.5),
    ("see-license", "licence", r"see (?:the )?licence (?:file|txt|md)(?: in the project root)? for (?:details|terms|more)", 3, 0.5),
    ("see-license", "governed", r"use of this source code is governed by an? .{1,40}? license that can be found in the license file", 1, 0.8),
    ("bsd-3-clause", "governed", r"use of this source code is governed by a bsd style license that can be found in the license file", 0, 0.95),
    ("mit", "governed", r"use of this source code is governed by an mit style license that can be found in the license file", 0, 0.95),
)


#: Identifiers as tags name licenses, and their labels. Their words alone say little, so they count after a tag or in a grant.
IDENTIFIERS = (
    ("MIT", "mit"), ("MIT-0", "mit-0"), ("ISC", "isc"), ("Zlib", "zlib"), ("0BSD", "0bsd"), ("BSD-2-Clause", "bsd-2-clause"), ("BSD-3-Clause", "bsd-3-clause"), ("BSD-4-Clause", "bsd-4-clause"), ("BSD-2-Clause-Patent", "bsd-patent"),
    ("Apache-1.1", "apache-1.1"), ("Apache-2.0", "apache-2"), ("BSL-1.0", "boost"), ("Unlicense", "unlicense"), ("WTFPL", "wtfpl"), ("HPND", "hpnd"), ("X11", "x11"), ("curl", "curl"), ("ICU", "icu"), ("Unicode-3.0", "unicode-3"),
    ("NCSA", "ncsa"), ("W3C", "w3c"), ("AFL-3.0", "afl-3"), ("ECL-2.0", "ecl-2"), ("UPL-1.0", "upl-1"), ("BlueOak-1.0.0", "bluoak-1"), ("Beerware", "beerware"), ("libpng-2.0", "libpng"), ("IJG", "ijg"), ("FTL", "freetype"),
    ("PHP-3.01", "php-3"), ("Ruby", "ruby"), ("TCL", "tcl"), ("Vim", "vim"), ("ZPL-2.1", "zpl-2.1"), ("Sleepycat", "sleepycat"), ("MulanPSL-2.0", "mulan-2"), ("OpenSSL", "openssl"), ("PostgreSQL", "postgresql"), ("Python-2.0", "python-2"), ("PSF-2.0", "python-2"),
    ("GPL-2.0-only", "gpl-2"), ("GPL-2.0-or-later", "gpl-2"), ("GPL-2.0", "gpl-2"), ("GPL-3.0-only", "gpl-3"), ("GPL-3.0-or-later", "gpl-3"), ("GPL-3.0", "gpl-3"), ("LGPL-2.1-only", "lgpl-2.1"), ("LGPL-2.1-or-later", "lgpl-2.1"), ("LGPL-2.1", "lgpl-2.1"),
    ("LGPL-3.0-only", "lgpl-3"), ("LGPL-3.0-or-later", "lgpl-3"), ("LGPL-3.0", "lgpl-3"), ("AGPL-3.0-only", "agpl-3"), ("AGPL-3.0-or-later", "agpl-3"), ("AGPL-3.0", "agpl-3"), ("GFDL-1.3", "gfdl"), ("MPL-1.1", "mpl-1.1"), ("MPL-2.0", "mpl-2"),
    ("EPL-1.0", "epl-1"), ("EPL-2.0", "epl-2"), ("CPL-1.0", "cpl-1"), ("IPL-1.0", "ipl-1"), ("CDDL-1.0", "cddl-1"), ("CDDL-1.1", "cddl-1"), ("EUPL-1.1", "eupl"), ("EUPL-1.2", "eupl"), ("CECILL-2.1", "cecill-2.1"), ("OSL-3.0", "osl-3"), ("QPL-1.0", "qpl-1"),
    ("APSL-2.0", "apsl-2"), ("MS-PL", "ms-pl"), ("MS-RL", "ms-rl"), ("RPL-1.5", "rpl-1.5"), ("Artistic-1.0", "artistic"), ("Artistic-2.0", "artistic-2"), ("SSPL-1.0", "sspl-1"), ("BUSL-1.1", "busl-1.1"), ("Elastic-2.0", "elastic-2"), ("Parity-7.0.0", "parity-7"),
    ("CC0-1.0", "cc0"), ("CC-BY-4.0", "cc-by"), ("CC-BY-3.0", "cc-by"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC-BY-SA-3.0", "cc-by-sa"), ("CC-BY-NC-4.0", "cc-by-nc"), ("CC-BY-ND-4.0", "cc-by-nd"), ("CC-BY-NC-SA-4.0", "cc-by-nc-sa"), ("CC-BY-NC-ND-4.0", "cc-by-nc-nd"),
    ("ODbL-1.0", "odbl"), ("ODC-By-1.0", "odc-by"), ("PDDL-1.0", "pddl"), ("OGL-UK-3.0", "ogl-uk"), ("etalab-2.0", "etalab-2"), ("OFL-1.1", "ofl-1.1"), ("LPPL-1.3c", "lppl-1.3c"),
)


@dataclass(frozen=True)
class Rule:
    order: int
    priority: int
    label: str
    keywords: tuple[str, ...]
    confidence: float
    pattern: re.Pattern


@lru_cache(maxsize=1)
def signature_rules() -> tuple[Rule, ...]:
    """All rules in order: each family's name in each phrase, identifiers after a tag and in a grant, and the signatures."""
    made = [(p, label, keyword, c, phrase.format(name=name)) for phrase, p, c in PHRASES for label, keyword, name in FAMILIES]
    ids = [(label, " ".join(WORD.findall(name.lower()))) for name, label in IDENTIFIERS]
    made += [(p, label, name.split()[0], c, phrase.format(name=name)) for phrase, p, c in PHRASES[:2] for label, name in ids]
    made += [(p, label, keyword, c, pattern) for label, keyword, pattern, p, c in SIGNATURES]
    made.sort(key=lambda x: x[0])
    return tuple(Rule(i, p, label, tuple(keyword.split("|")), c, re.compile(rf"(?<![^ ]){pattern}(?![^ ])")) for i, (p, label, keyword, c, pattern) in enumerate(made))


@lru_cache(maxsize=1)
def rules_by_keyword() -> dict[str, list[Rule]]:
    by: dict[str, list[Rule]] = {}
    for rule in signature_rules():
        for keyword in rule.keywords:
            by.setdefault(keyword, []).append(rule)
    return by


#: Keywords that also stand inside a longer word, as gpl in gplv3.
PARTS = ("agpl", "lgpl", "gpl", "bsd", "mpl")


def text_words(text: str | None) -> list[str]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []


def matches(joined: str, present: set[str]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in characters of the joined words, of all rules of which a keyword is present."""
    by = rules_by_keyword()
    keywords = {k for k in by if k in present}
    keywords |= {k for k in PARTS if k not in keywords and k in joined}
    rules = {rule.order: rule for k in keywords for rule in by[k]}
    return [(m.start(), m.end(), rule) for rule in rules.values() for m in rule.pattern.finditer(joined)]


def detections(joined: str, present: set[str]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) after suppression, in order of place."""
    found = matches(joined, present)
    # one sweep over starts: what begins no later and ends no earlier, with a rule of no lower priority, contains a detection
    found.sort(key=lambda x: (x[0], -x[1], x[2].priority, x[2].order))
    reach: dict[int, int] = {}  # priority -> the furthest end so far
    taken = []
    for start, end, rule in found:
        if all(e < end for p, e in reach.items() if p <= rule.priority):
            taken.append((start, end, rule))
        reach[rule.priority] = max(end, reach.get(rule.priority, 0))
    return taken


def base_places(joined: str) -> list[tuple[int, str]]:
    """(start, label) of each fixed phrase; places of a phrase may not overlap, as none begins with its own end."""
    padded = f" {joined} "
    out = []
    for phrase, label in BASE_PHRASES:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


def scan(text: str | None) -> dict:
    """All that is known of a text: counts and labels of the fixed phrases, labels, detections as word intervals, score."""
    words = text_words(text)
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    present = rules_by_keyword().keys() & set(words)
    joined = " ".join(words)
    if not present and not any(p in joined for p in PARTS):
        return out
    base = base_places(joined)
    found = detections(joined, present)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    word_at = lambda place: bisect_right(starts, place) - 1
    if base:
        out |= {"n_base": len(base), "first_word": word_at(min(base)[0]), "last_word": word_at(max(base)[0])}
    labels = {label for _, label in base}
    out["base_labels"] = ",".join(sorted(labels))
    out["labels"] = ",".join(sorted(labels | {r.label for _, _, r in found}))
    out["score"] = max([0.9 * bool(base), *(r.confidence for _, _, r in found)])
    out["spans"] = [{"first": word_at(s), "end": word_at(e - 1) + 1, "label": r.label, "confidence": r.confidence} for s, e, r in found]
    return out


SCAN_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string,confidence:double>>"


def license_scan(text: Column) -> Column:
    """A struct column of the scan of a text, see ``SCAN_SCHEMA``."""

    @F.pandas_udf(SCAN_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for texts in batches:
            pdf = pd.DataFrame([scan(t) for t in texts], columns=names)
            yield pdf.astype({"first_word": "Int64", "last_word": "Int64"})

    return run(text)
