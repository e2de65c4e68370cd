"""Hand-written licence rules: (label, keyword, pattern, priority), in order.

Patterns are over lower-case words with one space between them; a keyword stands in every match of its pattern.
"""

from __future__ import annotations

# File headers, as the licences ask for them.
HEADERS = [
    ("gpl", "free software you can redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 86),
    ("gpl-1.0-or-later", "either version 1", r"gnu general public licen[sc]e as published by the free software foundation either version 1 (?:of the licen[sc]e )?or at your option any later version", 88),
    ("gpl-2.0-or-later", "either version 2", r"gnu general public licen[sc]e as published by the free software foundation either version 2 (?:0 )?(?:of the licen[sc]e )?or at your option any later version", 88),
    ("gpl-3.0-or-later", "either version 3", r"gnu general public licen[sc]e as published by the free software foundation either version 3 (?:0 )?(?:of the licen[sc]e )?or at your option any later version", 88),
    ("gpl-2.0-only", "version 2", r"gnu general public licen[sc]e version 2 (?:only )?as published by the free software foundation", 87),
    ("gpl-3.0-only", "version 3", r"gnu general public licen[sc]e version 3 (?:only )?as published by the free software foundation", 87),
    ("lgpl-2.1-or-later", "either version 2 1", r"gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 (?:of the licen[sc]e )?or at your option any later version", 89),
    ("lgpl-3.0-or-later", "either version 3", r"gnu lesser general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version", 89),
    ("lgpl-2.0-or-later", "gnu library", r"gnu library general public licen[sc]e as published by the free software foundation either version 2 (?:of the licen[sc]e )?or at your option any later version", 89),
    ("agpl-3.0-or-later", "affero", r"gnu affero general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version", 89),
    ("agpl-3.0-only", "affero", r"gnu affero general public licen[sc]e version 3 (?:only )?as published by the free software foundation", 89),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 88),
    ("gfdl", "invariant sections", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts", 84),
    ("apache-2.0", "except in compliance", r"licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e", 88),
    ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements", 86),
    ("mpl-2.0", "this source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 88),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 88),
    ("mpl-1.0", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 0", 88),
    ("npl-1.1", "netscape public", r"the contents of this file are subject to the netscape public licen[sc]e version 1 [01]", 88),
    ("epl-1.0", "eclipse public", r"made available under the terms of the eclipse public licen[sc]e v ?1 0", 88),
    ("epl-2.0", "eclipse public", r"made available under the terms of the eclipse public licen[sc]e (?:v ?)?2 0", 88),
    ("cddl", "common development", r"the contents of this file are subject to the terms of (?:either )?the common development and distribution licen[sc]e", 88),
    ("cpl-1.0", "common public", r"made available under the terms of the common public licen[sc]e v ?1 0", 88),
    ("bsd", "bsd style", r"use of this source code is governed by a bsd style licen[sc]e", 86),
    ("mit", "mit style", r"use of this source code is governed by an mit style licen[sc]e", 86),
    ("bsl-1.0", "boost software", r"distributed under the boost software licen[sc]e version 1 0", 88),
    ("artistic", "same terms as perl", r"(?:you can|you may) redistribute it and or modify it under the same terms as perl(?: itself)?", 88),
    ("artistic", "same terms as", r"free software (?:licensed )?under the same terms as (?:the )?perl", 85),
    ("ruby", "same terms as ruby", r"(?:you can|you may) redistribute it and or modify it under the same terms as ruby(?: itself)?", 88),
    ("php-3.01", "php license", r"this source file is subject to version 3 01 of the php license", 88),
    ("php-3.0", "php license", r"this source file is subject to version 3 0 of the php license", 88),
    ("zpl-2.1", "zope public", r"subject to the provisions of the zope public licen[sc]e version 2 1", 88),
    ("zpl-2.0", "zope public", r"subject to the provisions of the zope public licen[sc]e version 2 0", 88),
    ("osl-3.0", "open software license", r"this source file is subject to the open software license osl 3 0", 88),
    ("afl-3.0", "academic free", r"this source file is subject to the academic free license afl 3 0", 88),
    ("eupl-1.2", "eupl", r"licen[sc]ed under the eupl version 1 2(?: or later)?", 87),
    ("eupl-1.1", "eupl", r"licen[sc]ed under the eupl version 1 1(?: or later)?", 87),
    ("sspl-1.0", "server side public", r"under the terms of the server side public licen[sc]e version 1 as published by mongodb", 89),
    ("elastic-2.0", "elastic license", r"licensed under the elastic license 2 0", 88),
    ("elastic", "elastic license", r"subject to the elastic license", 80),
    ("busl-1.1", "business source", r"use of this software is governed by the business source licen[sc]e", 88),
    ("ms-pl", "microsoft public", r"this source is subject to the microsoft public licen[sc]e", 88),
    ("cecill", "cecill", r"governed by the cecill(?: [bc])? licen[sc]e under french law", 88),
    ("ofl-1.1", "sil open font", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", 89),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 88),
    ("public-domain", "public domain", r"(?:has been|is|are) (?:hereby )?(?:placed|released|put) in(?:to)? the public domain", 75),
    ("public-domain", "public domain", r"(?:i|we|the authors?) hereby (?:place|release|dedicate) (?:this (?:file|code|work|software) )?(?:in|into|to) the public domain", 80),
    ("public-domain", "public domain", r"not subject to copyright protection and (?:is|are) in the public domain", 80),
    ("public-domain", "disclaims copyright", r"the author disclaims copyright to this source code", 84),
    ("beerware", "beer", r"beer ?ware licen[sc]e(?: revision 42)?", 80),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", 86),
    ("nasa-1.3", "nasa open source", r"nasa open source agreement(?: version 1 3)?", 70),
    ("nist", "national institute of standards", r"this software was developed at the national institute of standards and technology by employees of the federal government", 84),
    ("intel", "intel open source", r"intel open source licen[sc]e", 65),
    ("qpl-1.0", "q public", r"(?:the )?q public licen[sc]e(?: version 1 0)?", 65),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e(?: version 1 0)?", 65),
    ("apsl-2.0", "apple public source", r"apple public source licen[sc]e version 2 0", 75),
    ("apsl", "apple public source", r"apple public source licen[sc]e", 65),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e", 65),
    ("cpal-1.0", "common public attribution", r"common public attribution licen[sc]e(?: version 1 0)?", 70),
    ("lppl", "latex project", r"latex project public licen[sc]e(?: (?:version )?1 3c?)?", 70),
    ("lppl", "latex project", r"may be distributed and or modified under the conditions of the latex project public licen[sc]e", 88),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software licen[sc]e) v ?2", 75),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?", 75),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e", 65),
    ("openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail m(?: licen[sc]e)?", 65),
    ("commons-clause", "commons clause", r"commons clause (?:licen[sc]e )?condition v1 0", 86),
    ("commons-clause", "commons clause", r"commons clause", 60),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[sc]e(?: 1 0 0)?", 75),
]

# Grants, conditions and warranty notices of licence texts.
NOTICES = [
    ("mit", "above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 84),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 84),
    ("mit", "fitness for a particular purpose and noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable", 60),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising", 88),
    ("bsd", "retain the above copyright notice", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 84),
    ("bsd", "reproduce the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 84),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:the )?(?:\S+ ){1,12}?may be used to endorse or promote products derived from this software without specific prior written permission", 86),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 88),
    ("bsd", "regents of the university of california", r"copyright (?:c )?(?:\d{4} )+the regents of the university of california all rights reserved", 60),
    ("bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license", 86),
    ("isc", "the software is provided as is and the author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software", 84),
    ("0bsd", "with or without fee is hereby granted the software", r"with or without fee is hereby granted the software is provided as is", 88),
    ("ntp", "without fee is hereby granted provided", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?(?:with or )?without fee is hereby granted provided that", 86),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 88),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 88),
    ("zlib", "freely subject to the following restrictions", r"to alter it and redistribute it freely subject to the following restrictions", 86),
    ("bsl-1.0", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor", 88),
    ("wtfpl", "you just do what the fuck", r"you just do what the fuck you want to", 88),
    ("apache-2.0", "perpetual worldwide non exclusive", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 86),
    ("apache-2.0", "terms and conditions for use", r"terms and conditions for use reproduction and distribution 1 definitions", 80),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 78),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group", 80),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 86),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young", 86),
    ("gpl", "program is distributed in the hope", r"this program is distributed in the hope that it will be useful but without any warranty", 70),
    ("lgpl", "library is distributed in the hope", r"this library is distributed in the hope that it will be useful but without any warranty", 74),
    ("gpl", "received a copy of the gnu general", r"you should have received a copy of the gnu general public licen[sc]e", 82),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e", 84),
    ("lgpl", "received a copy of the gnu library", r"you should have received a copy of the gnu library general public licen[sc]e", 84),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e", 84),
    ("gpl-3.0", "29 june 2007", r"gnu general public licen[sc]e version 3 29 june 2007", 90),
    ("gpl-2.0", "june 1991", r"gnu general public licen[sc]e version 2 june 1991", 90),
    ("gpl-1.0", "february 1989", r"gnu general public licen[sc]e version 1 february 1989", 90),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999", 91),
    ("lgpl-3.0", "29 june 2007", r"gnu lesser general public licen[sc]e version 3 29 june 2007", 91),
    ("lgpl-2.0", "june 1991", r"gnu library general public licen[sc]e version 2 june 1991", 91),
    ("agpl-3.0", "19 november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007", 91),
    ("gfdl-1.3", "3 november 2008", r"gnu free documentation licen[sc]e version 1 3 3 november 2008", 91),
    ("gfdl-1.2", "november 2002", r"gnu free documentation licen[sc]e version 1 2 november 2002", 91),
    ("apache-2.0", "january 2004", r"apache licen[sc]e version 2 0 january 2004", 90),
    ("unlicense", "public domain we make this dedication", r"in the public domain we make this dedication for the benefit of the public at large", 86),
    ("cc0-1.0", "waived all copyright", r"to the extent possible under law (?:\S+ ){1,12}?has waived all copyright and related or neighboring rights", 86),
    ("cc-by", "creative commons attribution", r"this work is licen[sc]ed under (?:a|the) creative commons attribution (?:\d \d )?(?:international |unported |generic )?licen[sc]e", 82),
    ("cc-by-sa", "creative commons attribution", r"this work is licen[sc]ed under (?:a|the) creative commons attribution share ?alike (?:\d \d )?(?:international |unported |generic )?licen[sc]e", 84),
    ("cc-by-nc-sa", "creative commons attribution", r"this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:\d \d )?(?:international |unported |generic )?licen[sc]e", 84),
    ("cc-by-nc-nd", "creative commons attribution", r"this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:\d \d )?(?:international |unported |generic )?licen[sc]e", 84),
    ("cc-by-sa", "text is available under", r"text is available under the creative commons attribution share ?alike licen[sc]e(?: \d \d)?", 86),
    ("json", "for good not evil", r"the software shall be used for good not evil", 90),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 50),
    ("proprietary", "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited", 84),
    ("proprietary", "without the express written permission", r"may not be (?:reproduced|copied|distributed)(?: or \S+)* without the express written permission of", 55),
    ("proprietary", "trade secret", r"contains (?:confidential and proprietary|proprietary and confidential) information (?:and|or) trade secrets?", 60),
]

# Exceptions and choices between licences; they hold the names of the licences they change.
EXCEPTIONS = [
    ("gpl with classpath-exception-2.0", "classpath exception", r"(?:gnu general public licen[sc]e|gpl)(?: version 2| v ?2| 2 0)?(?: only)? with (?:the )?(?:gnu )?classpath exception", 93),
    ("classpath-exception-2.0", "independent modules to produce an executable", r"gives? you permission to link this library with independent modules to produce an executable", 93),
    ("gcc-exception-3.1", "gcc runtime library exception", r"gcc runtime library exception(?: version 3 1)?", 92),
    ("autoconf-exception", "configuration script generated by autoconf", r"a configuration script generated by autoconf", 88),
    ("bison-exception-2.2", "bison parser skeleton", r"part or all of the bison parser skeleton", 92),
    ("linux-syscall-note", "linux syscall note", r"(?:with )?linux syscall note", 92),
    ("linux-syscall-note", "normal system calls", r"user programs that use kernel services by normal system calls", 92),
    ("openssl-exception", "openssl", r"permission to link (?:the code of portions of )?this program with (?:the )?openssl(?: project s openssl)? library", 92),
    ("font-exception-2.0", "embed this font", r"if you create a document which uses this font and embed this font", 92),
    ("llvm-exception", "llvm exception", r"apache licen[sc]e (?:v ?|version )?2 0 with llvm exceptions?", 93),
    ("llvm-exception", "llvm exception", r"(?:with )?llvm exceptions?", 70),
    ("universal-foss-exception-1.0", "universal foss exception", r"universal foss exception(?: version 1 0)?", 92),
    ("qt-lgpl-exception", "qt", r"(?:the )?qt (?:company )?(?:gpl|lgpl) exception(?: version)? 1 [01]", 92),
    ("mit or apache-2.0", "mit", r"(?:dual )?licen[sc]ed under (?:either )?(?:of )?(?:the )?mit(?: licen[sc]e)? (?:and|or) (?:the )?apache(?: licen[sc]e)?(?: version)?(?: 2 0)?", 82),
    ("mit or apache-2.0", "mit", r"(?:dual )?licen[sc]ed under (?:either )?(?:of )?(?:the )?apache(?: licen[sc]e)?(?: version)?(?: 2 0)? (?:and|or) (?:the )?mit(?: licen[sc]e)?", 82),
    ("mit or gpl", "mit", r"dual licen[sc]ed under the (?:mit (?:and|or) gpl|gpl (?:and|or) mit)(?: version \d)? licen[sc]es?", 92),
    ("mit or gpl", "dual mit gpl", r"dual mit gpl", 90),
    ("bsd or gpl", "dual bsd gpl", r"dual bsd gpl", 90),
    ("mpl or gpl", "dual mpl gpl", r"dual mpl gpl", 90),
    ("mpl or gpl or lgpl", "mpl 1 1 gpl 2 0 lgpl 2 1", r"version mpl 1 1 gpl 2 0 lgpl 2 1", 92),
    ("artistic or gpl", "artistic", r"(?:the )?(?:gnu general public licen[sc]e|gpl) or (?:the )?artistic licen[sc]e", 85),
    ("epl or edl", "eclipse distribution", r"eclipse public licen[sc]e v ?\d 0 and eclipse distribution licen[sc]e v ?1 0", 92),
    ("cddl or gpl", "common development", r"(?:either )?the gnu general public licen[sc]e version 2 only gpl or the common development and distribution licen[sc]e", 92),
    ("commercial or agpl", "commercial", r"dual licen[sc]ed under (?:the )?agpl(?: v ?3)? and (?:a )?commercial licen[sc]e", 92),
    ("commercial or gpl", "commercial", r"dual licen[sc]ed under (?:the )?gpl(?: v ?\d)? and (?:a )?commercial licen[sc]e", 92),
]

# Files that hold or name a licence, manifest fields, badges and addresses.
REFERENCES = [
    ("see-file", "licen", r"(?:see|read) (?:the )?(?:accompanying |enclosed |included )?(?:file )?licen[sc]e(?: txt| md| rst)?(?: file)? for (?:the )?(?:full |more )?(?:licen[sc]e |licensing )?(?:details|text|information|terms)", 45),
    ("see-file", "the root", r"(?:found|available) in the licen[sc]e(?: txt| md)? file (?:in|at) the root(?: directory)? of this (?:source tree|repository|project)", 46),
    ("see-file", "see copying", r"see copying(?: txt)?(?: for (?:details|more information))?", 45),
    ("gpl", "file copying", r"see the file copying (?:for details )?(?:included )?(?:with|in) (?:this )?(?:distribution|package|the source)", 60),
    ("lgpl", "copying lesser", r"copying lesser(?: txt)?", 80),
    ("lgpl", "copying lib", r"copying lib(?: txt)?", 78),
    ("bsl-1.0", "license 1 0 txt", r"(?:accompanying file |boost org )license 1 0 txt", 89),
    ("gpl", "gpl", r"(?:see |file )?gpl(?: [123] 0)? txt", 70),
    ("lgpl", "lgpl", r"(?:see |file )?lgpl(?: [23] [01])? txt", 72),
    ("apache-2.0", "license 2 0 txt", r"licenses license 2 0 txt", 91),
    ("mit", "license mit", r"(?:see |file )?license mit(?: txt| md)?", 72),
    ("apache-2.0", "license apache", r"(?:see |file )?license apache(?: 2 0)?(?: txt| md)?", 72),
    ("mit", "badge license mit", r"(?:img )?shields io badge license mit", 82),
    ("apache-2.0", "badge license apache", r"shields io badge license apache(?: 2 0| 20license)", 82),
    ("gpl-3.0", "badge license gpl", r"shields io badge license gpl ?v?3(?: 0)?", 82),
    ("bsd", "badge license bsd", r"shields io badge license bsd(?: [234] clause)?", 82),
    ("mit", "osi approved", r"license osi approved mit license", 90),
    ("bsd", "osi approved", r"license osi approved bsd license", 90),
    ("apache", "osi approved", r"license osi approved apache software license", 90),
    ("gpl-2.0", "osi approved", r"license osi approved gnu general public license v2 gplv2", 91),
    ("gpl-3.0", "osi approved", r"license osi approved gnu general public license v3 gplv3", 91),
    ("lgpl-3.0", "osi approved", r"license osi approved gnu lesser general public license v3 lgplv3", 91),
    ("agpl-3.0", "osi approved", r"license osi approved gnu affero general public license v3", 91),
    ("mpl-2.0", "osi approved", r"license osi approved mozilla public license 2 0 mpl 2 0", 91),
    ("isc", "osi approved", r"license osi approved isc license iscl", 91),
    ("python", "osi approved", r"license osi approved python software foundation license", 91),
    ("gpl-2.0", "module license", r"module license gpl v2", 90),
    ("gpl", "module license", r"module license gpl", 88),
    ("proprietary", "module license", r"module license proprietary", 90),
    ("gpl-2.0", "gplv2", r"gplv2(?: only)?", 50),
    ("gpl-2.0-or-later", "gplv2", r"gplv2(?: or later| or any later version)", 55),
    ("gpl-3.0", "gplv3", r"gplv3(?: only)?", 50),
    ("gpl-3.0-or-later", "gplv3", r"gplv3(?: or later| or any later version)", 55),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?", 50),
    ("lgpl-3.0", "lgplv3", r"lgplv3", 50),
    ("agpl-3.0", "agplv3", r"agplv3", 50),
    ("apache-2.0", "choosealicense", r"choosealicense com licenses apache 2 0", 90),
    ("mit", "choosealicense", r"choosealicense com licenses mit", 90),
    ("gpl-3.0", "choosealicense", r"choosealicense com licenses gpl 3 0", 90),
    ("unlicense", "unlicense org", r"(?:refer to |see )?(?:https? )?unlicense org", 72),
    ("wtfpl", "wtfpl net", r"wtfpl net", 85),
    ("bsl-1.0", "boost org", r"boost org license 1 0 txt", 90),
    ("epl-1.0", "eclipse org", r"eclipse org legal epl v10(?: html)?", 90),
    ("epl-2.0", "eclipse org", r"eclipse org legal epl (?:2 0|v20)(?: html)?", 90),
    ("edl-1.0", "eclipse org", r"eclipse org org documents edl v10(?: html| php)?", 90),
    ("ofl", "scripts sil org", r"scripts sil org ofl", 90),
    ("php", "php net license", r"php net license(?: 3 01| 3 0)?(?: txt)?", 88),
    ("cecill", "cecill info", r"cecill info", 80),
    ("sspl-1.0", "mongodb com licensing", r"mongodb com licensing server side public license", 91),
    ("lppl", "latex project org", r"latex project org lppl(?: txt)?", 88),
]

WRITTEN = [*HEADERS, *NOTICES, *EXCEPTIONS, *REFERENCES]
