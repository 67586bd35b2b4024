"""Signatures of license texts, headers, notices and addresses, each written by hand.

A signature is a label, a pattern over words (lower case, one space between, marks gone), a word or words one of which
every match holds, and a confidence. No match begins or ends more than 20 words from such a word.
"""

SIGNATURES = (
    # permissive texts and headers
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby",), 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial",), 0.9),
    ("mit", r"to use copy modify merge publish distribute sublicense and or sell copies of the software", ("sublicense",), 0.9),
    ("mit", r"opensource org licen[cs]es? mit(?: license)?(?: php)?", ("opensource",), 0.95),
    ("mit", r"expat licen[cs]e", ("expat",), 0.9),
    ("mit-0", r"opensource org licen[cs]es? mit 0", ("opensource",), 0.95),
    ("x11", r"the name of the x consortium shall not be used in advertising or otherwise", ("consortium",), 0.95),
    ("x11", r"x11 licen[cs]e", ("x11",), 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby",), 0.9),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", ("disclaims",), 0.85),
    ("isc", r"opensource org licen[cs]es? isc(?: license)?(?: txt)?", ("opensource",), 0.95),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0 ?bsd)(?: licen[cs]e)?", ("bsd", "0bsd"), 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions",), 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", ("redistributions",), 0.9),
    ("bsd", r"use of this source code is governed by a bsd style licen[cs]e(?: that can be found in the licen[cs]e file)?", ("bsd",), 0.95),
    ("bsd-2-clause", r"opensource org licen[cs]es? bsd 2 clause", ("opensource",), 0.95),
    ("bsd-3-clause", r"opensource org licen[cs]es? bsd 3 clause", ("opensource",), 0.95),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,6}nor the names of its contributors may be used to endorse or promote products", ("contributors",), 0.95),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", ("patent",), 0.95),
    ("bsd-3-clause-no-nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", ("nuclear",), 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", ("advertising",), 0.95),
    ("apache-2", r"(?:www )?apache org licenses license 2 0(?: txt| html)?", ("apache",), 1.0),
    ("apache-2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache",), 1.0),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", ("asf",), 0.95),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("applicable",), 0.85),
    ("apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", ("royalty",), 0.9),
    ("apache-2", r"opensource org licen[cs]es? apache 2 0", ("opensource",), 0.95),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", ("apache",), 0.8),
    ("apache-1.0", r"this product includes software developed by the apache group", ("apache",), 0.9),
    ("ecl-2", r"educational community licen[cs]e(?: version)?(?: 2 0| 2)?", ("educational",), 0.9),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("implied",), 0.9),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("misrepresented",), 0.95),
    ("zlib", r"the origin of this software must not be misrepresented", ("misrepresented",), 0.9),
    ("libpng", r"png reference library licen[cs]e(?: version 2)?", ("png",), 0.9),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ("organization",), 0.95),
    ("bsl-1", r"(?:www )?boost org license 1 0(?: txt)?", ("boost",), 1.0),
    ("postgresql", r"this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("hereby",), 0.95),
    ("ncsa", r"university of illinois(?: ncsa)? open source licen[cs]e", ("illinois",), 0.95),
    ("afl-3", r"academic free licen[cs]e(?: version)?(?: v?3 0| v?3)?", ("academic",), 0.9),
    ("upl-1", r"universal permissive licen[cs]e(?: upl)?(?: version)?(?: v?1 0)?", ("permissive",), 0.95),
    ("blueoak-1", r"blue oak model licen[cs]e(?: 1 0 0)?", ("oak",), 0.95),
    ("mulanpsl-2", r"mulan (?:psl|permissive software licen[cs]e)(?: version)?(?: v?2)?", ("mulan",), 0.95),
    ("php-3", r"php licen[cs]e(?: version)?(?: v?3 01| v?3 0)?", ("php",), 0.9),
    ("php-3", r"this product includes php software freely available from", ("php",), 0.95),
    ("zpl-2", r"zope public licen[cs]e(?: zpl)?(?: version)?(?: 2 [01])?", ("zope",), 0.95),
    ("vim", r"(?:vim licen[cs]e|same (?:terms|licen[cs]e) as vim(?: itself)?)", ("vim",), 0.9),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", ("jpeg",), 0.95),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", ("openssl",), 0.95),
    ("ssleay", r"this product includes cryptographic software written by eric young", ("cryptographic",), 0.95),
    ("curl", r"curl licen[cs]e", ("curl",), 0.85),
    ("icu", r"icu licen[cs]e", ("icu",), 0.85),
    ("unicode", r"unicode(?: inc)? licen[cs]e agreement(?: data files and software)?", ("unicode",), 0.95),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", ("beer",), 1.0),
    ("beerware", r"beer ?ware licen[cs]e", ("beerware", "beer"), 0.95),
    ("json", r"the software shall be used for good not evil", ("evil",), 1.0),
    ("sqlite-blessing", r"may you do good and not evil", ("evil",), 0.95),
    ("freetype", r"freetype (?:project )?licen[cs]e", ("freetype",), 0.9),
    ("w3c", r"w3c software (?:notice and |and document )?licen[cs]e", ("w3c",), 0.95),
    ("perl", r"(?:under )?the same terms as(?: the)? perl(?: 5)?(?: programming language)?(?: system)? itself", ("perl",), 0.95),
    ("ruby", r"under either the terms of the 2 clause bsdl", ("bsdl",), 0.95),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied", ("intent",), 0.95),
    ("artistic-2", r"(?:www )?perlfoundation org artistic license 2 0", ("perlfoundation",), 0.95),
    ("psf-2", r"psf licen[cs]e agreement for python(?: [23] [0-9]{1,2})?", ("psf",), 0.95),
    ("cnri-python", r"cnri (?:open source )?licen[cs]e agreement", ("cnri",), 0.9),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", ("sil",), 1.0),
    ("ofl-1.1", r"scripts sil org ofl", ("sil",), 0.95),
    # copyleft headers and texts
    ("gpl-1-or-later", r"gnu general public license as published by the free software foundation either version 1(?: of the license)? or at your option any later version", ("foundation",), 1.0),
    ("gpl-2-or-later", r"gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version", ("foundation",), 1.0),
    ("gpl-3-or-later", r"gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", ("foundation",), 1.0),
    ("gpl-2-only", r"gnu general public license version 2(?: only)? as published by the free software foundation", ("foundation",), 1.0),
    ("gpl-3-only", r"gnu general public license version 3(?: only)? as published by the free software foundation", ("foundation",), 1.0),
    ("gpl", r"you should have received a copy of the gnu general public license along with this (?:program|software|library|file)", ("gnu",), 0.9),
    ("gpl", r"implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu",), 0.9),
    ("gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it", ("freedom",), 0.85),
    ("gpl-3", r"the licenses for most software and other practical works are designed to take away your freedom", ("freedom",), 0.85),
    ("gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works", ("copyleft",), 0.95),
    ("gpl", r"(?:www )?gnu org (?:copyleft|licenses) gpl(?: html| txt)?", ("gnu",), 0.9),
    ("gpl-2", r"(?:www )?gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt)?", ("gnu",), 1.0),
    ("gpl-3", r"(?:www )?gnu org licenses gpl 3 0(?: html| txt)?", ("gnu",), 1.0),
    ("gpl-2-classpath", r"classpath exception (?:to the gpl|as provided by oracle)", ("classpath",), 0.95),
    ("gpl-2-classpath", r"spdx license identifier gpl 2 0(?: only| or later)? with classpath exception(?: 2 0)?", ("classpath",), 1.0),
    ("gpl-2-syscall", r"spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note", ("syscall",), 1.0),
    ("gpl-3-gcc", r"gcc runtime library exception(?: version)?(?: 3 1)?", ("gcc",), 0.95),
    ("gpl-2-or-later", r"spdx license identifier gpl 2 0 or later", ("spdx",), 1.0),
    ("gpl-2-only", r"spdx license identifier gpl 2 0 only", ("spdx",), 1.0),
    ("gpl-3-or-later", r"spdx license identifier gpl 3 0 or later", ("spdx",), 1.0),
    ("gpl-3-only", r"spdx license identifier gpl 3 0 only", ("spdx",), 1.0),
    ("lgpl-2-or-later", r"gnu library general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version", ("foundation",), 1.0),
    ("lgpl-2.1-or-later", r"gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version", ("foundation",), 1.0),
    ("lgpl-3-or-later", r"gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", ("foundation",), 1.0),
    ("lgpl-2", r"gnu library general public license(?: version)?(?: v?2 0| v?2)?", ("gnu",), 0.8),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|file)", ("gnu",), 0.9),
    ("lgpl-2.1", r"(?:www )?gnu org licenses(?: old licenses)? lgpl 2 1(?: html| txt)?", ("gnu",), 1.0),
    ("lgpl-3", r"(?:www )?gnu org licenses lgpl 3 0(?: html| txt)?", ("gnu",), 1.0),
    ("lgpl-2.1-or-later", r"spdx license identifier lgpl 2 1 or later", ("spdx",), 1.0),
    ("lgpl-2.1-only", r"spdx license identifier lgpl 2 1 only", ("spdx",), 1.0),
    ("lgpl-3-or-later", r"spdx license identifier lgpl 3 0 or later", ("spdx",), 1.0),
    ("lgpl-3-only", r"spdx license identifier lgpl 3 0 only", ("spdx",), 1.0),
    ("agpl-3-or-later", r"gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", ("foundation",), 1.0),
    ("agpl-3-only", r"gnu affero general public license version 3(?: only)? as published by the free software foundation", ("affero",), 1.0),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file)", ("affero",), 0.9),
    ("agpl-3", r"all users interacting with it remotely through a computer network", ("remotely",), 0.9),
    ("agpl-3", r"(?:www )?gnu org licenses agpl 3 0(?: html| txt)?", ("gnu",), 1.0),
    ("agpl-3-or-later", r"spdx license identifier agpl 3 0 or later", ("spdx",), 1.0),
    ("agpl-3-only", r"spdx license identifier agpl 3 0 only", ("spdx",), 1.0),
    ("gfdl-1.2", r"gnu free documentation license version 1 2(?: or any later version)?", ("gnu",), 0.95),
    ("gfdl-1.3", r"gnu free documentation license version 1 3(?: or any later version)?", ("gnu",), 0.95),
    ("gfdl", r"gnu free documentation license", ("gnu",), 0.85),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0", ("mozilla",), 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", ("mozilla",), 1.0),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla",), 1.0),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", ("mpl",), 0.95),
    ("mpl-2", r"(?:www )?mozilla org mpl 2 0", ("mozilla",), 1.0),
    ("mpl-2-no-copyleft-exception", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", ("incompatible",), 0.95),
    ("npl", r"netscape public licen[cs]e(?: version)?(?: 1 [01])?", ("netscape",), 0.95),
    ("epl-1", r"(?:www )?eclipse org legal epl v10(?: html)?", ("eclipse",), 1.0),
    ("epl-2", r"(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?", ("eclipse",), 1.0),
    ("epl-1", r"made available under the terms of the eclipse public license v1 0", ("eclipse",), 1.0),
    ("epl-2", r"made available under the terms of the eclipse public license (?:v ?)?2 0", ("eclipse",), 1.0),
    ("edl-1", r"eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?", ("eclipse",), 0.95),
    ("cpl-1", r"common public license(?: version| v)?(?: 1 0)?", ("public",), 0.9),
    ("cpal-1", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?", ("attribution",), 0.95),
    ("ipl-1", r"ibm public licen[cs]e(?: version)?(?: 1 0)?", ("ibm",), 0.95),
    ("cddl-1", r"subject to the terms of the common development and distribution license", ("distribution",), 1.0),
    ("cddl-1.1", r"glassfish(?: dev)? java net public cddl gpl 1 1(?: html)?", ("glassfish",), 0.95),
    ("spl-1", r"sun public licen[cs]e(?: version)?(?: 1 0)?", ("sun",), 0.9),
    ("apsl-2", r"apple public source licen[cs]e(?: version)?(?: 2 0)?", ("apple",), 0.95),
    ("ms-pl", r"microsoft public licen[cs]e(?: ms pl)?", ("microsoft",), 0.95),
    ("ms-rl", r"microsoft reciprocal licen[cs]e(?: ms rl)?", ("microsoft",), 0.95),
    ("cecill-2", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)?(?: 2 [01])?", ("cecill",), 0.9),
    ("cecill-b", r"cecill b(?: free software)? licen[cs]e(?: agreement)?", ("cecill",), 0.95),
    ("cecill-c", r"cecill c(?: free software)? licen[cs]e(?: agreement)?", ("cecill",), 0.95),
    ("lppl-1.3", r"latex project public licen[cs]e(?: version)?(?: 1 3c?)?", ("latex",), 0.95),
    ("qpl-1", r"q public licen[cs]e(?: version)?(?: 1 0)?", ("public",), 0.9),
    ("sleepycat", r"sleepycat (?:public |software )?licen[cs]e", ("sleepycat",), 0.95),
    ("rpl-1.5", r"reciprocal public licen[cs]e(?: version)?(?: 1 5)?", ("reciprocal",), 0.95),
    ("watcom-1", r"(?:sybase )?open watcom public licen[cs]e", ("watcom",), 0.95),
    ("nasa-1.3", r"nasa open source agreement(?: version)?(?: 1 3)?", ("nasa",), 0.95),
    ("eupl-1.2", r"(?:licen[cs]ed under the )?eupl (?:v ?|version )?1 2(?: or later)?", ("eupl",), 0.9),
    # creative commons and data
    ("cc0", r"creativecommons org publicdomain zero 1 0", ("creativecommons",), 1.0),
    ("cc0", r"has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", ("waiving",), 0.95),
    ("cc0", r"has waived all copyright and related or neighbou?ring rights to", ("waived",), 0.95),
    ("cc-pdm", r"creativecommons org publicdomain mark 1 0", ("creativecommons",), 1.0),
    ("cc-by", r"creativecommons org licenses by [1-4] [05]", ("creativecommons",), 1.0),
    ("cc-by-sa", r"creativecommons org licenses by sa [1-4] [05]", ("creativecommons",), 1.0),
    ("cc-by-nd", r"creativecommons org licenses by nd [1-4] [05]", ("creativecommons",), 1.0),
    ("cc-by-nc", r"creativecommons org licenses by nc [1-4] [05]", ("creativecommons",), 1.0),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1-4] [05]", ("creativecommons",), 1.0),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1-4] [05]", ("creativecommons",), 1.0),
    ("cc-by", r"this work is licensed under a creative commons attribution [1-4] [05] (?:international|unported|generic) license", ("commons",), 1.0),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license", ("commons",), 0.95),
    ("odbl-1", r"(?:open data commons )?open database licen[cs]e(?: odbl)?(?: v1 0| 1 0)?", ("database",), 0.95),
    ("odc-by-1", r"open data commons attribution licen[cs]e(?: v1 0| 1 0)?", ("commons",), 0.95),
    ("pddl-1", r"public domain dedication and licen[cs]e(?: pddl)?", ("dedication",), 0.9),
    ("ogl-uk-3", r"open government licen[cs]e(?: version| v)?(?: ?3 0| ?3)", ("government",), 0.95),
    ("ogl-uk-3", r"contains public sector information licensed under the open government licen[cs]e", ("sector",), 0.9),
    ("opl-1", r"open publication licen[cs]e(?: v1 0| version 1 0)?", ("publication",), 0.9),
    ("cdla-permissive", r"community data license agreement permissive(?: version)?(?: [12] 0)?", ("permissive",), 0.95),
    ("cdla-sharing", r"community data license agreement sharing(?: version)?(?: 1 0)?", ("sharing",), 0.95),
    # public domain
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", ("compile",), 1.0),
    ("unlicense", r"(?:www )?unlicense org", ("unlicense",), 0.95),
    ("wtfpl", r"you just do what the fuck you want to", ("fuck",), 0.95),
    ("wtfpl", r"(?:www )?wtfpl net", ("wtfpl",), 0.95),
    ("public-domain", r"this (?:work|file|code|software|program) is (?:hereby )?(?:in|released into|released to|placed in) the public domain", ("domain",), 0.9),
    ("public-domain", r"not subject to copyright protection (?:and is in the public domain|in the united states|within the united states)", ("copyright",), 0.85),
    ("public-domain", r"no copyright is claimed in the united states", ("claimed",), 0.85),
    # restricted use
    ("elastic-2", r"elastic licen[cs]e(?: version)?(?: v?2 0| v2)?", ("elastic",), 0.95),
    ("busl-1.1", r"business source licen[cs]e(?: version)?(?: 1 1)?", ("business",), 0.95),
    ("sspl-1", r"server side public licen[cs]e(?: version| v)?(?: ?1)?", ("server",), 0.95),
    ("commons-clause", r"commons clause licen[cs]e condition(?: v ?1 0)?", ("commons",), 1.0),
    ("polyform-noncommercial", r"polyform noncommercial licen[cs]e(?: 1 0 0)?", ("polyform",), 1.0),
    ("polyform-small-business", r"polyform small business licen[cs]e(?: 1 0 0)?", ("polyform",), 1.0),
    ("polyform-shield", r"polyform shield licen[cs]e(?: 1 0 0)?", ("polyform",), 1.0),
    ("fsl-1.1", r"functional source licen[cs]e(?: version)?(?: 1 1)?", ("functional",), 0.95),
    ("openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)? licen[cs]e", ("openrail", "rail"), 0.9),
    ("llama-community", r"llama (?:2|3|3 [123]|4) community licen[cs]e(?: agreement)?", ("llama",), 1.0),
    ("gemma-terms", r"gemma terms of use", ("gemma",), 0.95),
    ("hippocratic", r"hippocratic licen[cs]e", ("hippocratic",), 0.95),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|software|program|document))?(?: via any medium)? is strictly prohibited", ("unauthorized", "unauthorised"), 0.95),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)(?: information of)?", ("proprietary",), 0.8),
    ("proprietary", r"no part of this (?:publication|document|software|work|book) may be reproduced", ("reproduced",), 0.9),
    ("proprietary", r"end user licen[cs]e agreement", ("agreement",), 0.75),
    ("proprietary", r"licensed materials property of ibm", ("ibm",), 0.95),
)
