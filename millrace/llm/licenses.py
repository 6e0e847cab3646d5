"""License scan by ordered signature rules. DataFrame functions only.

Texts are normalised to lower-case words. A rule has a keyword, a regex over these words, a label, a priority (1 is
highest) and a confidence. Every match of a rule holds its keyword, and every keyword begins a word: one pass finds the
keywords that occur, and only their rules are tried, so no rule is gated out. Of overlapping detections one goes that
lies inside of another of at least its priority; a denial ("not licensed under ...") is a detection without a label, so
what it denies goes with it. Everything is computed within a row, by built-in functions, so nothing shuffles and no group
can be hot.

Signatures of license texts, notices, references and denials are written by hand in ``TEXTS``. Families of licenses have
names, versions and SPDX words; each gives rules for a notice, a name with version and a bare name, and for its places in
SPDX tags and in "or" and "and" expressions, where a license is named by its identifier alone.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import ascii_lower

#: Phrases whose places are counted, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_LIC = "licen[cs]e"
#: label, keyword, names (a regex), versions.
FAMILIES = (
    ("gpl", "general public", rf"(?:gnu )?general public {_LIC}", ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "general public", rf"(?:gnu )?(?:lesser|library) general public {_LIC}", ("2.0", "2.1", "3.0")),
    ("lgpl", "lgpl", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "affero", rf"(?:gnu )?affero general public {_LIC}", ("1.0", "3.0")),
    ("agpl", "agpl", "agpl", ("1.0", "3.0")),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation {_LIC}", ("1.1", "1.2", "1.3")),
    ("apache", "apache", rf"apache(?: software)? {_LIC}", ("1.0", "1.1", "2.0")),
    ("mit", "mit", rf"(?:the )?mit {_LIC}|mit", ()),
    ("mit", "expat", rf"(?:the )?expat {_LIC}", ()),
    ("x11", "x11", rf"x11 {_LIC}", ()),
    ("bsd", "bsd", rf"(?:new |modified |revised |simplified )?bsd(?: style)?(?: {_LIC})?", ("2 clause", "3 clause", "4 clause")),
    ("isc", "isc", rf"isc {_LIC}", ()),
    ("mpl", "mozilla", rf"mozilla public {_LIC}", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", rf"eclipse public {_LIC}", ("1.0", "2.0")),
    ("edl", "eclipse", rf"eclipse distribution {_LIC}", ("1.0",)),
    ("cddl", "common development", rf"common development and distribution {_LIC}", ("1.0", "1.1")),
    ("cpl", "common public", rf"common public {_LIC}", ("0.5", "1.0")),
    ("ipl", "ibm public", rf"ibm public {_LIC}", ("1.0",)),
    ("artistic", "artistic", rf"(?:perl )?artistic {_LIC}", ("1.0", "2.0")),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_LIC}", ()),
    ("bsl", "boost", rf"boost software {_LIC}", ("1.0",)),
    ("busl", "business source", rf"business source {_LIC}", ("1.1",)),
    ("sspl", "server side", rf"server side public {_LIC}", ("1.0",)),
    ("elastic", "elastic", rf"elastic {_LIC}", ("1.0", "2.0")),
    ("eupl", "european union", rf"european union public {_LIC}", ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2")),
    ("cecill", "cecill", "cecill(?: b| c)?", ("1.0", "2.0", "2.1")),
    ("ofl", "open font", rf"(?:sil )?open font {_LIC}", ("1.0", "1.1")),
    ("odbl", "open database", rf"open database {_LIC}", ("1.0",)),
    ("odc-by", "open data commons", rf"open data commons attribution {_LIC}", ("1.0",)),
    ("pddl", "public domain dedication", rf"public domain dedication and {_LIC}", ("1.0",)),
    ("unlicense", "unlicen", "(?:the )?unlicen[cs]e", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2.0",)),
    ("0bsd", "0bsd", "0bsd", ()),
    ("psf", "python software", rf"python software foundation {_LIC}", ("2.0",)),
    ("ruby", "ruby", rf"ruby {_LIC}", ()),
    ("php", "php", rf"php {_LIC}", ("3.0", "3.01")),
    ("vim", "vim", rf"vim {_LIC}", ()),
    ("openssl", "openssl", rf"openssl {_LIC}", ()),
    ("postgresql", "postgresql", rf"postgresql {_LIC}", ()),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {_LIC}", ()),
    ("ms-pl", "microsoft", rf"microsoft public {_LIC}", ()),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {_LIC}", ()),
    ("afl", "academic free", rf"academic free {_LIC}", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open software", rf"open software {_LIC}", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("upl", "universal permissive", rf"universal permissive {_LIC}", ("1.0",)),
    ("mulanpsl", "mulan", rf"mulan ?(?:psl|permissive software {_LIC})", ("1.0", "2.0")),
    ("rail", "openrail", "openrail(?: m)?", ()),
    ("rail", "open rail", "open rail(?: m)?", ()),
    ("cc0", "cc0", "cc0", ("1.0",)),
    ("cc0", "creative commons", "creative commons zero", ("1.0",)),
    *(
        (f"cc-{kind}", "cc by" if short else "creative commons", name, ("1.0", "2.0", "2.5", "3.0", "4.0"))
        for kind, words in (
            ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
            ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
            ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
        )
        for short, name in ((True, "cc " + kind.replace("-", " ")), (False, f"creative commons {words}"))
    ),
)
#: label, keyword, signature, confidence. Written by hand; "" is the label of a denial.
TEXTS = (
    # denials
    ("", "neither ", r"neither (?:the )?(?:[a-z0-9]+ ){1,4}nor (?:the )?(?:[a-z0-9]+ ){1,4}licen[cs]ed", 1.0),
    ("", "is not ", r"is not (?:a |an )?(?:under |covered by )?(?:the )?(?:gnu )?[la]?gpl(?:v[123])?(?: [123] [01])?(?: licen[cs]ed?)?", 1.0),
    # short forms of versions
    ("gpl-1.0", "gplv1 ", r"gplv1", 0.9), ("gpl-2.0", "gplv2 ", r"gplv2(?: 0)?", 0.9), ("gpl-3.0", "gplv3 ", r"gplv3(?: 0)?", 0.9),
    ("lgpl-2.0", "lgplv2 ", r"lgplv2(?: 0)?", 0.9), ("lgpl-2.1", "lgplv2 ", r"lgplv2 1", 0.9), ("lgpl-3.0", "lgplv3 ", r"lgplv3(?: 0)?", 0.9), ("agpl-3.0", "agplv3 ", r"agplv3(?: 0)?", 0.9),
    ("gpl-2.0-or-later", "gplv2 ", r"gplv2 (?:0 )?or (?:any )?later", 1.0), ("gpl-3.0-or-later", "gplv3 ", r"gplv3 (?:0 )?or (?:any )?later", 1.0),
    ("", "not ", rf"not (?:be |been |being |currently |yet |itself )?(?:licen[cs]ed|released|distributed|available|covered|published|provided|shared|governed) (?:under|by)(?: (?!but |instead |rather |however |it )[a-z0-9]+){{1,8}}", 1.0),
    ("", "never ", r"never (?:been )?(?:licen[cs]ed|released|distributed|available|published|shared) (?:under|by)(?: (?!but |instead |rather |however |it )[a-z0-9]+){1,8}", 1.0),
    ("", "no longer ", r"no longer (?:licen[cs]ed|released|distributed|available|covered|published|shared) (?:under|by)(?: (?!but |instead |rather |however |it )[a-z0-9]+){1,8}", 1.0),
    ("", "neither ", r"neither (?:the )?(?:[a-z0-9]+ ){1,4}nor (?:the )?(?:[a-z0-9]+ ){1,4}(?:licen[cs]es? )?appl(?:y|ies)", 1.0),
    ("", "incompatible ", r"incompatible with (?:the )?(?:(?!but |and )[a-z0-9]+ ?){1,6}", 1.0),
    ("", "isn t ", r"isn t (?:licen[cs]ed|released|distributed|available|covered) (?:under|by)(?: (?!but |instead |rather |however |it )[a-z0-9]+){1,8}", 1.0),
    # MIT and its kin
    ("mit", "permission is ", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "permission is ", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "the above ", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "use copy ", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 0.95),
    ("mit", "opensource org ", r"opensource org licenses mit", 1.0),
    ("ncsa", "to deal ", r"to deal with the software without restriction", 0.9),
    ("x11", "except as ", r"except as contained in this notice the name of (?:[a-z0-9]+ ){1,10}shall not be used in advertising", 1.0),
    ("unicode", "permission is ", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    ("bsl-1.0", "permission is ", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1.0),
    ("bsl-1.0", "boost org ", r"boost org license 1 0 txt", 1.0),
    ("json", "the software ", r"the software shall be used for good not evil", 1.0),
    # ISC, HPND and public-permission texts
    ("isc", "permission to ", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "permission to ", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("hpnd", "permission to ", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 1.0),
    ("hpnd", "permission to ", r"permission to use copy modify distribute and sell this software and its documentation for any purpose", 1.0),
    ("fsfap", "copying and ", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    ("fsfap", "this file ", r"this file is offered as is without any warranty", 0.9),
    ("permissive", "provided as ", r"provided as is without warranty of any kind express or implied", 0.4),
    ("postgresql", "in no ", r"in no event shall the university of california be liable to any party for direct indirect special incidental", 1.0),
    ("beerware", "if we ", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 1.0),
    ("wtfpl", "do what ", r"do what the f[a-z]+ you want to public licen[cs]e", 1.0),
    ("wtfpl", "you just ", r"you just do what the f[a-z]+ you want to", 1.0),
    # BSD
    ("bsd", "redistribution and ", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions of ", r"redistributions of source code must retain the above copyright notice", 0.95),
    ("bsd", "redistributions in ", r"redistributions in binary form must reproduce the above copyright notice", 0.95),
    ("bsd-3-clause", "neither the ", r"neither the names? of (?:[a-z0-9]+ ){1,14}nor the names of (?:its|their|other) contributors may be used to endorse or promote", 1.0),
    ("bsd-3-clause", "may not ", r"may not be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4-clause", "all advertising ", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd", "this software ", r"this software is provided by the (?:copyright holders|regents|authors?)(?: and contributors)? as is and any express or implied warranties", 0.9),
    ("bsd-2-clause", "opensource org ", r"opensource org licenses bsd 2 clause", 1.0),
    ("bsd-3-clause", "opensource org ", r"opensource org licenses bsd 3 clause", 1.0),
    ("bsd-2-clause-patent", "a perpetual ", r"a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except for failure to satisfy the conditions of this license )?patent license", 0.7),
    ("sleepycat", "redistributions in ", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    ("openssl", "this product ", r"this product includes software developed by the openssl project", 1.0),
    ("openssl", "this product ", r"this product includes cryptographic software written by eric young", 1.0),
    # zlib, libpng, image and font libraries
    ("zlib", "the origin ", r"the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered source ", r"altered source versions must be plainly marked as such", 1.0),
    ("zlib", "in no ", r"in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("libpng", "libpng ", r"libpng (?:version [0-9 ]+)?licen[cs]e", 0.9),
    ("libpng", "this copy ", r"this copy of the libpng notices is provided for your convenience", 1.0),
    ("ijg", "this software ", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", "portions of ", r"portions of this software are copyright (?:c )?(?:[a-z0-9]+ ){1,4}the freetype project", 1.0),
    ("ftl", "the freetype ", r"the freetype project licen[cs]e", 1.0),
    ("ofl-1.1", "this font ", r"this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl", "scripts sil ", r"scripts sil org ofl", 1.0),
    ("ofl", "the font", r"the fonts? (?:and derivatives|themselves) (?:however )?(?:cannot be released|may not be sold)", 0.7),
    # Apache
    ("apache-2.0", "licensed under ", r"licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2.0", "apache org ", r"apache org licenses license 2 0", 1.0),
    ("apache-2.0", "opensource org ", r"opensource org licenses apache 2 0", 1.0),
    ("apache", "you may ", r"you may not use this file except in compliance with the license", 0.8),
    ("apache", "unless required ", r"unless required by applicable law or agreed to in writing software distributed under the license", 0.8),
    ("apache", "licensed to ", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-1.1", "this product ", r"this product includes software developed by the apache software foundation", 0.7),
    ("apache-2.0", "apache ", r"apache (?:version |v )?2 0", 0.9),
    ("apache-2.0", "apache2 ", r"apache2", 0.7),
    ("apache-2.0", "asl 2 ", r"asl 2 0", 0.8),
    ("apache-2.0", "al2 ", r"al2(?: 0)?", 0.4),
    # GNU
    ("gpl", "you can ", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("lgpl", "you can ", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 1.0),
    ("agpl", "you can ", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 1.0),
    ("gpl-2.0", "under the ", r"under the terms of version 2 of the gnu general public licen[cs]e", 1.0),
    ("gpl-3.0", "under the ", r"under the terms of version 3 of the gnu general public licen[cs]e", 1.0),
    ("gpl-2.0-or-later", "either version ", r"either version 2 (?:0 )?of the licen[cs]e or at your option any later version", 0.95),
    ("gpl-3.0-or-later", "either version ", r"either version 3 (?:0 )?of the licen[cs]e or at your option any later version", 0.95),
    ("lgpl-2.1-or-later", "either version ", r"either version 2 1 of the licen[cs]e or at your option any later version", 1.0),
    ("gpl", "you should ", r"you should have received a copy of the gnu general public licen[cs]e along with this", 0.95),
    ("lgpl", "you should ", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this", 0.95),
    ("agpl", "you should ", r"you should have received a copy of the gnu affero general public licen[cs]e along with this", 0.95),
    ("gpl", "this program ", r"this program is distributed in the hope that it will be useful but without any warranty", 0.8),
    ("lgpl", "this library ", r"this library is distributed in the hope that it will be useful but without any warranty", 0.8),
    ("gpl-2.0", "the licenses ", r"the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("gpl-3.0", "the licenses ", r"the licenses for most software and other practical works are designed to take away your freedom", 1.0),
    ("agpl-3.0", "the gnu ", r"the gnu affero general public licen[cs]e is a free copyleft license for software and other kinds of works", 1.0),
    ("gpl", "everyone is ", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    ("gpl", "gnu org ", r"gnu org (?:licenses|copyleft) gpl(?: [0-9] 0)?", 0.9),
    ("lgpl", "gnu org ", r"gnu org (?:licenses|copyleft) lgpl(?: [0-9] [0-9])?", 0.9),
    ("agpl", "gnu org ", r"gnu org licenses agpl(?: 3 0)?", 0.9),
    ("gfdl", "gnu org ", r"gnu org (?:licenses|copyleft) fdl(?: 1 [0-9])?", 0.9),
    ("gfdl", "permission is ", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1.0),
    ("gfdl", "with no ", r"with no invariant sections no front cover texts and no back cover texts", 1.0),
    ("gpl-exception", "classpath exception ", r"classpath exception (?:2 0)?", 0.9),
    ("gpl-exception", "gcc runtime ", r"gcc runtime library exception", 0.9),
    ("gpl-exception", "autoconf exception ", r"autoconf exception(?: [23] 0)?", 0.9),
    ("gpl-exception", "bison exception ", r"bison exception(?: 2 2)?", 0.9),
    ("gpl-exception", "font exception ", r"font exception(?: 2 0)?", 0.8),
    ("gpl-exception", "linking exception ", r"linking exception", 0.7),
    ("gpl-exception", "as a ", r"as a special exception (?:[a-z0-9]+ ){1,12}(?:link|combine|linking|compile)", 0.8),
    ("llvm-exception", "llvm exception", r"llvm exceptions?", 0.9),
    ("copyleft", "copyleft ", r"copyleft", 0.3),
    # weak copyleft
    ("mpl-2.0", "this source ", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? 2 0", 1.0),
    ("mpl-1.1", "the contents ", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 1.0),
    ("mpl-2.0", "mozilla org ", r"mozilla org mpl 2 0", 1.0),
    ("mpl", "mozilla org ", r"mozilla org mpl", 0.8),
    ("epl", "this program ", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 1.0),
    ("epl-1.0", "eclipse org ", r"eclipse org legal epl v10", 1.0),
    ("epl-2.0", "eclipse org ", r"eclipse org legal epl 2 0", 1.0),
    ("cddl", "the contents ", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 1.0),
    ("cpal-1.0", "common public ", r"common public attribution licen[cs]e", 0.9),
    ("eupl", "licensed under ", r"licensed under the eupl", 1.0),
    ("cecill", "this software ", r"this software is governed by the cecill(?: [bc])? licen[cs]e", 1.0),
    ("artistic-1.0", "the intent ", r"the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic", "same terms ", r"same terms as perl(?: itself)?", 0.9),
    ("ruby", "same terms ", r"same terms as ruby(?: itself)?", 0.9),
    ("psf-2.0", "psf is ", r"psf is making python available to licensee on an as is basis", 1.0),
    ("psf-2.0", "this licen", r"this licen[cs]e agreement is between the python software foundation", 1.0),
    ("php", "this product ", r"this product includes php software freely available from", 1.0),
    # Creative Commons and data
    ("cc-by", "creativecommons org ", r"creativecommons org licenses by(?: [1-4] [05])", 1.0),
    ("cc-by-sa", "creativecommons org ", r"creativecommons org licenses by sa", 1.0),
    ("cc-by-nd", "creativecommons org ", r"creativecommons org licenses by nd", 1.0),
    ("cc-by-nc", "creativecommons org ", r"creativecommons org licenses by nc(?: [1-4] [05])", 1.0),
    ("cc-by-nc-sa", "creativecommons org ", r"creativecommons org licenses by nc sa", 1.0),
    ("cc-by-nc-nd", "creativecommons org ", r"creativecommons org licenses by nc nd", 1.0),
    ("cc0-1.0", "creativecommons org ", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "creativecommons org ", r"creativecommons org publicdomain mark 1 0", 1.0),
    ("cc0-1.0", "to the ", r"to the extent possible under law (?:[a-z0-9]+ ){1,12}has (?:dedicated|waived) all copyright", 1.0),
    ("cc0-1.0", "cc zero ", r"cc zero", 0.7),
    ("creative-commons", "some rights ", r"some rights reserved", 0.4),
    ("creative-commons", "creative commons ", r"creative commons", 0.4),
    ("cdla-permissive", "community data ", r"community data licen[cs]e agreement permissive", 1.0),
    ("cdla-sharing", "community data ", r"community data licen[cs]e agreement sharing", 1.0),
    ("ogl", "open government ", r"open government licen[cs]e(?: v?[123] 0)?", 0.9),
    ("etalab", "licence ouverte ", r"licence ouverte", 0.9),
    ("odc-by", "open data ", r"open data commons attribution", 0.8),
    ("dl-de", "data licen", r"data licen[cs]e germany (?:attribution|zero)", 0.9),
    # public domain
    ("unlicense", "free and ", r"free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense org ", r"unlicense org", 1.0),
    ("public-domain", "released ", r"released (?:in|into|to) the public domain", 0.8),
    ("public-domain", "placed in", r"placed (?:in|into) the public domain", 0.8),
    ("public-domain", "dedicated to ", r"dedicated to the public domain", 0.8),
    ("public-domain", "is in ", r"is in the public domain", 0.8),
    ("public-domain", "public domain ", r"public domain", 0.4),
    ("public-domain", "not subject ", r"not subject to copyright protection", 0.8),
    ("public-domain", "work of ", r"work of the (?:us|u s|united states) government", 0.6),
    ("public-domain", "no copyright ", r"no copyright(?: restrictions)?", 0.4),
    ("public-domain", "no known ", r"no known copyright restrictions", 0.7),
    # source available, models
    ("busl-1.1", "the licensed ", r"the licensed work is (?:c |copyright )?(?:19|20)[0-9]{2}", 0.9),
    ("busl-1.1", "additional use ", r"additional use grant", 0.7),
    ("sspl-1.0", "if you ", r"if you make the functionality of the program or a modified version available to third parties as a service", 1.0),
    ("commons-clause", "commons clause ", r"commons clause(?: licen[cs]e condition)?", 0.9),
    ("commons-clause", "the licen", r"the licen[cs]e does not grant to you the right to sell the software", 1.0),
    ("elastic-2.0", "you may ", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("polyform", "polyform ", r"polyform (?:noncommercial|shield|perimeter|strict|small business|free trial|internal use)(?: licen[cs]e)?", 0.95),
    ("fsl-1.1", "functional source ", r"functional source licen[cs]e", 0.95),
    ("llama", "llama ", r"llama (?:[234] )?(?:[0-9] )?community licen[cs]e(?: agreement)?", 0.95),
    ("gemma", "gemma ", r"gemma (?:is provided under|terms of use)", 0.9),
    ("rail", "use based ", r"use based restrictions (?:as )?referenced", 0.7),
    ("rail", "bigscience ", r"bigscience (?:rail|bloom rail) ?(?:1 0 )?licen[cs]e", 0.95),
    ("rail", "creativeml ", r"creativeml open ?rail(?: m)?", 0.95),
    ("nvidia", "nvidia ", r"nvidia (?:open model|source code|software) licen[cs]e", 0.9),
    # restrictions
    ("proprietary", "all rights ", r"all rights reserved", 0.6),
    ("proprietary", "proprietary and ", r"proprietary and confidential", 0.8),
    ("proprietary", "confidential and ", r"confidential and proprietary", 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or [a-z]+)?(?: of (?:this|the) [a-z]+)?(?: via any medium)? is (?:strictly )?prohibited", 0.9),
    ("proprietary", "no part ", r"no part of this (?:publication|book|document|work|file|software) may be (?:reproduced|copied|distributed|transmitted)", 0.8),
    ("proprietary", "without the ", r"without the (?:prior |express |explicit )*(?:written )?(?:permission|consent) of the (?:publisher|author|owner|copyright)", 0.7),
    ("proprietary", "may not ", r"may not be (?:copied|reproduced|distributed|redistributed|resold)(?: (?:in whole )?(?:or in part )?)?without", 0.7),
    ("proprietary", "licensed not ", r"licensed not sold", 0.8),
    ("proprietary", "for internal ", r"for internal use only", 0.6),
    ("proprietary", "not for ", r"not for (?:re)?distribution", 0.6),
    ("proprietary", "trade secret", r"trade secrets? of", 0.6),
    ("eula", "end user ", r"end user licen[cs]e agreement", 0.9),
    ("eula", "by installing ", r"by installing (?:[a-z0-9]+ ){1,8}you agree to", 0.7),
    ("eula", "by downloading ", r"by downloading (?:[a-z0-9]+ ){1,8}you agree to", 0.7),
    ("evaluation", "for evaluation ", r"for evaluation (?:purposes )?only", 0.6),
    ("noncommercial", "for non ", r"for non commercial (?:use|purposes)(?: only)?", 0.5),
    ("noncommercial", "noncommercial ", r"noncommercial (?:use|purposes) only", 0.5),
    ("noncommercial", "for personal ", r"for personal (?:and |or )?(?:non commercial |noncommercial )?use only", 0.5),
    ("academic", "for academic ", r"for academic (?:use|purposes)(?: only)?", 0.5),
    ("academic", "for research ", r"for research (?:use|purposes) only", 0.5),
    ("academic", "for educational ", r"for educational (?:use|purposes) only", 0.5),
    # notices without a name
    ("copyright", "copyright ", r"copyright (?:c |by )?(?:19|20)[0-9][0-9]", 0.3),
    ("copyright", "©", r"© ?(?:19|20)[0-9][0-9]", 0.3),
    ("unknown-license", "licensed ", r"licensed (?:under|to)", 0.3),
    ("unknown-license", "subject to ", r"subject to the (?:terms of the )?licen[cs]e", 0.2),
    ("unknown-license", "see the ", r"see the licen[cs]e(?: file)? for", 0.3),
    ("unknown-license", "see license ", r"see license(?: file)?", 0.3),
    ("dual-license", "dual licen", r"dual licen[cs](?:ed|ing|e)", 0.4),
)
_NOTICE = "(?:licen[cs]ed|released|distributed|available|covered|published|provided|shared) (?:under|by) (?:the )?(?:terms (?:of|and conditions of) (?:the )?)?"
_LATER = "(?: only)? (?:or (?:at your option )?(?:any )?later(?: version)?|or newer)"
#: Licenses named by an identifier alone, and what such a name may look like in "or" and "and" expressions.
_BARE = ("mit", "isc", "zlib", "unlicense", "0bsd", "x11", "ncsa", "postgresql", "wtfpl", "gpl", "lgpl", "agpl", "mpl", "epl", "bsd", "apache", "cc0")
_NAMED = f"(?:{'|'.join((*_BARE, 'bsl', 'artistic', 'cddl', 'eupl'))})(?: v?[0-9]{{1,2}})?(?: [0-9]{{1,2}})?(?: clause)?(?: licen[cs]e)?(?: only| or later)?"


def _version(v: str) -> tuple[str, str]:
    """The regex of a version's words and its form in a label."""
    if "clause" in v:
        n, spelled = v[0], {"2": "two", "3": "three", "4": "four"}[v[0]]
        return f"(?:{n}|{spelled}) clause", f"{n}-clause"
    major, minor = v.split(".")
    return f"(?:version |ver |v )?v?{major}" + (f"(?: {minor})?(?! [0-9])" if minor == "0" else f" {minor}"), v


def _spdx(identifier: str) -> str:
    """The words of an SPDX identifier where a tag names it: after the tag, or after an operator of the tag's expression."""
    words = identifier.replace("-", " ").replace(".", " ")
    tag = "spdx licen[cs]e identifier (?:[a-z0-9 ]{1,80} (?:or|and|with) )?"
    end = "(?! or later| only)" if identifier[-1:].isdigit() else ""
    return f"{words}(?<= {tag}{words}){end}"


def rules() -> list[dict]:
    """All rules, in order: highest priority first, and as listed within one."""
    out = [dict(label=lab, keyword=key, regex=text, priority=1 if c == 1.0 else 2 if c >= 0.9 else 4, confidence=c) for lab, key, text, c in TEXTS]
    add = lambda label, key, regex, p, c: out.append(dict(label=label, keyword=key, regex=regex, priority=p, confidence=c))
    for label, key, names, versions in FAMILIES:
        noun = f"(?:{names})"
        add(label, key, f"{_NOTICE}(?:a |an )?{noun}", 2, 0.9)
        add(label, key, noun if key != "mit" else rf"mit {_LIC}", 3, 0.7)
        for v in versions:
            words, form = _version(v)
            named = f"{noun} {words}" if "clause" not in v else f"(?:{words} {noun}|{noun} {words})"
            add(f"{label}-{form}", key, named, 2, 0.9)
            add(f"{label}-{form}", key, f"{_NOTICE}(?:a |an )?{named}", 1, 1.0)
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                add(f"{label}-{form}-or-later", key, f"(?:{_NOTICE})?{named}{_LATER}", 1, 1.0)
    tags = dict.fromkeys(f"{label}-{form}".strip("-") for label, _, _, versions in FAMILIES for form in ([_version(v)[1] for v in versions] or [""]))
    for tag in tags:
        first = tag.replace("-", " ").replace(".", " ").split()[0]
        add(tag, f"{first} ", _spdx(tag), 1, 1.0)
        if first in ("gpl", "lgpl", "agpl", "gfdl"):
            add(f"{tag}-only", f"{first} ", _spdx(f"{tag}-only"), 1, 1.0)
            add(f"{tag}-or-later", f"{first} ", _spdx(f"{tag}-or-later"), 1, 1.0)
    for name in _BARE:
        add(name, f"{name} ", f"{name}(?<= {_NAMED} (?:or|and) (?:the )?{name})", 3, 0.8)
        add(name, f"{name} ", f"{name}(?= (?:or|and) (?:the )?{_NAMED} )", 3, 0.8)
    out.sort(key=lambda r: r["priority"])
    return [r | {"rule": i, "regex": f"(?<= )(?:{r['regex']})(?= )"} for i, r in enumerate(out)]


def _any(words: list[str]) -> str:
    """A regex of any of the strings, the longest first, that shares their beginnings."""
    out = []
    for first, some in groupby(sorted(set(words)), key=lambda w: w[:1]):
        rest = [w[1:] for w in some]
        longer = [w for w in rest if w]
        tail = _any(longer) if longer else ""
        out.append((first if first.isalnum() or first in " ©" else "\\" + first) + (f"(?:{tail})?" if tail and "" in rest else tail))
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


#: The keywords of all rules: a text without any has no detection.
GATE = tuple(sorted({r["keyword"] for r in rules()}))
_GATE = f" (?=({_any(list(GATE))}))"


def normal(text: Column) -> Column:
    """Lower-case words with single spaces between and around them; one space where there are none."""
    gaps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), gaps, " ")


def _marked(norm: Column, regex: Column) -> Column:
    """The words of a normal text; those that begin a match start with control character 1, those that end one end with 2."""
    return F.split(F.trim(F.regexp_replace(norm, regex, F.lit("\x01$0\x02"))), " ")


def places(norm: Column, regex: Column) -> Column:
    """First and last word of each match, in order: array of struct(start, end)."""
    found = _marked(norm, regex)
    at = lambda test: F.filter(F.transform(found, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    return F.arrays_zip(at(lambda w: F.startswith(w, F.lit("\x01"))).alias("start"), at(lambda w: F.endswith(w, F.lit("\x02"))).alias("end"))


_RULES = "map<string,array<struct<rule:int,label:string,regex:string,priority:int,confidence:double>>>"
_SPAN = "struct<start:int,end:int,priority:int,rule:int,label:string,confidence:double>"


def detections(norm: Column) -> Column:
    """All matches of the rules whose keyword occurs, sorted by start, then the longest, then the order of rules.

    The longest keyword at each place is found; the rules of keywords that begin it are tried too. A rule that is tried
    for two keywords gives its detections twice, and the second ones lie inside of the first.
    """
    by = {hit: [r for r in rules() if hit.startswith(r["keyword"])] for hit in GATE}
    hits = F.array_distinct(F.regexp_extract_all(norm, F.lit(_GATE), F.lit(1)))
    tried = F.flatten(F.transform(hits, lambda h: F.element_at(F.from_json(F.lit(json.dumps(by)), _RULES), h)))
    spans = F.transform(
        F.filter(tried, lambda r: F.rlike(norm, r["regex"])),
        lambda r: F.transform(
            places(norm, r["regex"]),
            lambda p: F.struct(
                p["start"].alias("start"), (-p["end"]).alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"),
                r["label"].alias("label"), r["confidence"].alias("confidence"),
            ),
        ),
    )
    return F.array_sort(F.flatten(spans))


def surviving(sorted_spans: Column) -> Column:
    """struct(reach, labels, best): what is left after suppression; ``reach`` is the last word of each priority so far.

    A detection goes if an earlier one in this order reaches its end and has at least its priority. One without a label
    only makes others go. The state holds four numbers and each label once, so its size does not grow with the detections.
    """
    start = F.struct(
        F.array(*[F.lit(-1)] * 4).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best")
    )

    def step(state: Column, d: Column) -> Column:
        end, p = -d["end"], d["priority"]
        inside = F.array_max(F.slice(state["reach"], 1, p)) >= end
        silent = inside | (d["label"] == "")
        reach = F.transform(state["reach"], lambda r, i: F.when(i + 1 == p, F.greatest(r, end)).otherwise(r))
        return F.struct(
            F.when(inside, state["reach"]).otherwise(reach).alias("reach"),
            F.when(silent, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(silent, state["best"]).otherwise(F.greatest(state["best"], d["confidence"])).alias("best"),
        )

    return F.aggregate(sorted_spans, start, step)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row.

    The base phrases' places are all counted: n_base, their least and greatest first word (null without any), and their
    labels. ``labels`` has those and the surviving detections'; ``score`` is the highest confidence of these, 0 without.
    Labels are distinct, sorted and joined by commas. Null and empty texts have no words. Null ids, repeated rows and
    other columns change nothing. No rows give no rows.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    norm = F.col("__norm")
    rows = docs.select(F.col(id_col).alias("__id"), normal(F.col(text_col)).alias("__norm"))
    spans = "array<struct<start:int,end:int,priority:int,rule:int,label:string,confidence:double>>"
    base = [F.when(F.contains(norm, F.lit(f" {p} ")), places(norm, F.lit(f"(?<= ){p}(?= )"))).otherwise(none) for p, _ in BASE]
    rows = rows.select(
        "__id",
        (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        *[b.alias(f"__b{i}") for i, b in enumerate(base)],
        surviving(detections(norm).cast(spans)).alias("__found"),
    )
    starts = F.transform(F.concat(*[F.col(f"__b{i}") for i in range(len(BASE))]), lambda p: p["start"].cast("long"))
    own = F.array_compact(F.array(*[F.when(F.size(f"__b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    nothing = F.array().cast("array<string>")
    return rows.select("__id", "n_words", "__found", starts.alias("__starts"), own.alias("__own")).select(
        F.col("__id").alias(id_col), "n_words", F.size("__starts").cast("long").alias("n_base"),
        F.array_min("__starts").alias("first_word"), F.array_max("__starts").alias("last_word"),
        joined(F.col("__own")).alias("base_labels"),
        joined(F.concat("__own", F.coalesce("__found.labels", nothing))).alias("labels"),
        F.greatest(F.coalesce("__found.best", F.lit(0.0)), F.when(F.size("__own") > 0, 0.7).otherwise(0.0)).alias("score"),
    )
