r"""Hand-written license signatures, in order of priority.

Each line: label, expression, keywords, confidence.  A space in an expression stands for
any white space; texts are lower-cased (A-Z).  The first keywords that a text holds admit the rule (see ``license_rules``).
Full grants and titles come first, then notices, clauses, exceptions, references to files and weak hints.
"""

from __future__ import annotations

SIGNATURES = [
    # grants that open a license's text
    ("mit", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", ("hereby granted",), 0.95),
    ("mit-0", r"mit no attribution", ("no attribution",), 0.95),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", ("permission to use",), 0.9),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation", ("permission to use",), 0.9),
    ("bsd", r"redistribution and use in source and binary forms", ("redistribution and use",), 0.9),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", ("provided 'as is'",), 0.9),
    ("boost-1.0", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy", ("hereby granted",), 0.95),
    ("ofl-1.1", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of the font software", ("font software",), 0.97),
    ("unicode", r"to any person obtaining a copy of the unicode data files", ("unicode data",), 0.97),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",), 0.95),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", ("verbatim or modified",), 0.9),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", ("verbatim copies",), 0.9),
    ("vim", r"vim is charityware", ("charityware",), 0.95),
    ("curl", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", ("with or without fee",), 0.9),
    ("ntp", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted", ("with or without fee",), 0.9),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement", ("written agreement",), 0.95),
    ("ncsa", r"to any person obtaining a copy of this software and associated documentation files \(the \"software\"\), to deal with the software", ("to deal with the software",), 0.95),
    ("json", r"the software shall be used for good,? not evil", ("not evil",), 0.97),
    ("beerware", r"you can buy me a beer in return", ("buy me a beer",), 0.97),
    ("postcardware", r"send (?:me|the author) a postcard", ("postcard",), 0.7),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", ("this instrument",), 0.95),
    ("fsf-ap", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty", ("without royalty",), 0.95),
    ("fsf-ul", r"this (?:configure|file) .{0,80}the free software foundation gives unlimited permission to copy", ("unlimited permission",), 0.95),
    ("bsl-source", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-?production use", ("production use",), 0.97),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", ("managed service",), 0.97),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", ("as a service",), 0.97),
    ("commons-clause", r"the license does not grant to you,? the right to sell the software", ("right to sell the software",), 0.97),
    ("polyform", r"polyform (?:noncommercial|small business|strict|shield|internal use|perimeter|free trial) license", ("polyform",), 0.95),
    ("blueoak-1.0", r"blue oak model license", ("blue oak",), 0.95),
    ("upl-1.0", r"universal permissive license", ("universal permissive",), 0.95),
    ("ecl-2.0", r"educational community license", ("educational community",), 0.95),
    ("mulan-psl", r"mulan permissive software license", ("mulan",), 0.95),
    ("cecill", r"cecill(?:-[abc])? (?:free software )?license", ("cecill",), 0.9),
    ("eupl", r"licensed under the eupl", ("eupl",), 0.95),
    ("ipl-1.0", r"ibm public license", ("ibm public",), 0.95),
    ("rpl", r"reciprocal public license", ("reciprocal public",), 0.95),
    ("nposl", r"non-?profit open software license", ("profit open software",), 0.95),
    ("sleepycat", r"sleepycat license", ("sleepycat",), 0.95),
    ("sun-sissl", r"sun industry standards source license", ("sun industry",), 0.95),
    ("spl", r"sun public license", ("sun public",), 0.95),
    ("npl", r"netscape public license", ("netscape public",), 0.95),
    ("apsl", r"apple public source license", ("apple public",), 0.95),
    ("nasa-1.3", r"nasa open source agreement", ("nasa open source",), 0.95),
    ("intel", r"intel open source license", ("intel open source",), 0.95),
    ("lppl", r"latex project public license", ("latex project",), 0.95),
    ("w3c", r"w3c software (?:and document )?(?:notice and )?license", ("w3c software",), 0.95),
    ("zpl", r"zope public license", ("zope public",), 0.95),
    ("plexus", r"plexus classworlds license", ("plexus",), 0.9),
    ("ijg", r"independent jpeg group(?:'s)? (?:software|license)", ("independent jpeg",), 0.8),
    ("freetype", r"freetype (?:project )?license", ("freetype",), 0.95),
    ("imagemagick", r"imagemagick license", ("imagemagick",), 0.95),
    ("xfree86", r"xfree86 (?:project )?license", ("xfree86",), 0.95),
    ("tcl", r"tcl/?tk license", ("tcl",), 0.9),
    ("sqlite", r"the author disclaims copyright to this source code", ("disclaims copyright",), 0.95),
    ("sqlite", r"may you do good and not evil", ("good and not evil",), 0.9),
    ("public-domain", r"(?:released|placed|dedicated|put) (?:in)?to the public domain", ("public domain",), 0.8),
    ("public-domain", r"(?:is|are) (?:hereby )?in the public domain", ("public domain",), 0.7),
    ("public-domain", r"no copyright is claimed", ("no copyright",), 0.7),
    ("cc0-1.0", r"to the extent possible under law,? .{0,200}waived all copyright", ("waived all copyright",), 0.95),
    ("cc0-1.0", r"no rights reserved", ("no rights reserved",), 0.6),
    ("cc-pdm", r"public domain mark", ("public domain mark",), 0.9),
    # notices that refer to a license
    ("gpl-3-or-later", r"either version 3 of the license, or \(at your option\) any later version", ("any later version",), 0.95),
    ("gpl-2-or-later", r"either version 2 of the license, or \(at your option\) any later version", ("any later version",), 0.95),
    ("lgpl-2.1-or-later", r"either version 2\.1 of the license, or \(at your option\) any later version", ("any later version",), 0.95),
    ("gpl-1-or-later", r"either version 1, or \(at your option\) any later version", ("any later version",), 0.95),
    ("gpl-or-later", r"or \(at your option\) any later version", ("any later version",), 0.8),
    ("gpl", r"this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license", ("redistribute it",), 0.97),
    ("lgpl", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license", ("redistribute it",), 0.97),
    ("agpl", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license", ("redistribute it",), 0.97),
    ("gpl", r"you should have received a copy of the gnu general public license", ("should have received",), 0.95),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", ("should have received",), 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public license", ("should have received",), 0.95),
    ("gpl", r"free software foundation, inc\., (?:59 temple place|51 franklin st|675 mass ave)", ("free software foundation",), 0.7),
    ("gpl-2-only", r"gnu general public license version 2(?:\.0)? only", ("version 2",), 0.97),
    ("gpl-2-only", r"under version 2 of the gnu general public license", ("version 2",), 0.9),
    ("gpl-3-only", r"gnu general public license version 3(?:\.0)? only", ("version 3",), 0.97),
    ("gpl-3-only", r"under version 3 of the gnu general public license", ("version 3",), 0.9),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", ("this document under the terms",), 0.97),
    ("gfdl", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts", ("invariant sections",), 0.9),
    ("apache-2.0", r"licensed under the apache license, version 2\.0", ("apache",), 0.97),
    ("apache-2.0", r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at", ("except in compliance",), 0.85),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", ("contributor license",), 0.97),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis", ("agreed to in writing",), 0.85),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", ("apache software foundation",), 0.8),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0", ("source code form",), 0.97),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file", ("copy of the mpl",), 0.95),
    ("mpl-2.0-no-copyleft-exception", r"this source code form is \"incompatible with secondary licenses\"", ("secondary licenses",), 0.95),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", ("contents of this file",), 0.97),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", ("accompanying materials",), 0.97),
    ("epl-2.0", r"https?://www\.eclipse\.org/legal/epl-(?:2\.0|v20)", ("eclipse.org",), 0.95),
    ("epl-1.0", r"https?://www\.eclipse\.org/legal/epl-v10", ("eclipse.org",), 0.95),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", ("contents of this file",), 0.97),
    ("osl-3.0", r"licensed under the open software license version 3\.0", ("open software",), 0.97),
    ("afl-3.0", r"licensed under the academic free license version 3\.0", ("academic free",), 0.97),
    ("ms-pl", r"this (?:code|software) is licensed under the microsoft public license", ("microsoft public",), 0.97),
    ("artistic-2.0", r"licensed under the artistic license 2\.0", ("artistic",), 0.97),
    ("perl", r"(?:you can redistribute it and/or modify it )?under the same terms as perl(?: itself)?", ("as perl",), 0.9),
    ("python-2.0", r"python software foundation license version 2", ("python software",), 0.95),
    ("ruby", r"(?:redistribute|distributed) .{0,60}under the same terms as ruby", ("as ruby",), 0.9),
    ("php-3.01", r"this source file is subject to version 3\.01 of the php license", ("php license",), 0.97),
    ("php-3.0", r"this source file is subject to version 3\.0 of the php license", ("php license",), 0.97),
    ("boost-1.0", r"distributed under the boost software license,? version 1\.0", ("boost",), 0.97),
    ("zlib", r"for conditions of distribution and use, see copyright notice in zlib\.h", ("zlib.h",), 0.95),
    ("libpng", r"this code is released under the libpng license", ("libpng",), 0.95),
    ("openssl", r"this product includes software developed by the openssl project", ("openssl project",), 0.9),
    ("ssleay", r"this product includes cryptographic software written by eric young", ("eric young",), 0.9),
    ("x11", r"except as contained in this notice, the name of .{0,60}shall not be used in advertising", ("except as contained",), 0.9),
    ("ofl-1.1", r"this font software is licensed under the sil open font license, version 1\.1", ("font software",), 0.97),
    ("odbl-1.0", r"made available under the open database license", ("open database",), 0.97),
    ("odc-by-1.0", r"made available under the open data commons attribution license", ("open data",), 0.97),
    ("pddl-1.0", r"public domain dedication and license", ("domain dedication",), 0.95),
    ("cdla-permissive", r"community data license agreement ?[-–—]? ?permissive", ("community data",), 0.95),
    ("cdla-sharing", r"community data license agreement ?[-–—]? ?sharing", ("community data",), 0.95),
    ("dl-de-by", r"datenlizenz deutschland ?[-–—]? ?namensnennung", ("datenlizenz",), 0.95),
    ("dl-de-zero", r"datenlizenz deutschland ?[-–—]? ?zero", ("datenlizenz",), 0.95),
    ("etalab", r"licence ouverte(?:/open licence)?", ("licence ouverte",), 0.9),
    ("ogl-uk", r"open government licen[cs]e(?: v\d(?:\.\d)?)?", ("open government",), 0.9),
    ("openrail-m", r"responsible ai licen[cs]e", ("responsible ai",), 0.9),
    ("llama", r"llama (?:2|3(?:\.\d)?) community license", ("community license",), 0.95),
    ("gemma", r"gemma terms of use", ("gemma",), 0.9),
    # Creative Commons in words and links
    ("cc-by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd", ("creativecommons.org",), 0.95),
    ("cc-by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa", ("creativecommons.org",), 0.95),
    ("cc-by-nc", r"creativecommons\.org/licenses/by-nc(?![a-z-])", ("creativecommons.org",), 0.95),
    ("cc-by-nd", r"creativecommons\.org/licenses/by-nd", ("creativecommons.org",), 0.95),
    ("cc-by-sa", r"creativecommons\.org/licenses/by-sa", ("creativecommons.org",), 0.95),
    ("cc-by", r"creativecommons\.org/licenses/by(?![a-z-])", ("creativecommons.org",), 0.95),
    ("cc0-1.0", r"creativecommons\.org/publicdomain/zero", ("creativecommons.org",), 0.95),
    ("cc-pdm", r"creativecommons\.org/publicdomain/mark", ("creativecommons.org",), 0.95),
    ("cc-by-nc", r"attribution[- ]non-?commercial (?:\d\.\d )?(?:international|unported|generic)", ("commercial",), 0.85),
    ("cc-by-sa", r"attribution[- ]share-?alike (?:\d\.\d )?(?:international|unported|generic)", ("share",), 0.85),
    ("cc-by-nd", r"attribution[- ]no-?derivatives (?:\d\.\d )?(?:international|unported|generic)", ("derivatives",), 0.85),
    ("cc-by", r"attribution (?:\d\.\d )(?:international|unported|generic)", ("attribution",), 0.8),
    ("cc", r"some rights reserved", ("some rights",), 0.5),
    ("cc", r"licensed under a creative commons licen[cs]e", ("creative commons",), 0.7),
    # clauses
    ("bsd-3-clause", r"neither the name of .{1,120}nor the names of its contributors may be used to endorse or promote", ("neither the name",), 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", ("advertising materials",), 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice", ("redistributions of source",), 0.85),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", ("redistributions in binary",), 0.85),
    ("bsd", r"this software is provided by the (?:regents|copyright holders|author)s?(?: and contributors)? [\"'`]+as is", ("provided by the",), 0.8),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", ("permission notice shall",), 0.9),
    ("mit", r"the software is provided \"as is\", without warranty of any kind, express or implied", ("without warranty of any kind",), 0.75),
    ("isc", r"the software is provided \"as is\" and the author disclaims all warranties", ("author disclaims",), 0.85),
    ("zlib", r"altered source versions must be plainly marked as such", ("plainly marked",), 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", ("misrepresented",), 0.9),
    ("zlib", r"this notice may not be removed or altered from any source distribution", ("removed or altered",), 0.85),
    ("gpl", r"the gnu general public license is a free, copyleft license", ("copyleft license",), 0.95),
    ("gpl", r"the licenses for most software are designed to take away your freedom", ("take away your freedom",), 0.95),
    ("gpl-2", r"gnu general public license version 2, june 1991", ("june 1991",), 0.97),
    ("gpl-3", r"gnu general public license version 3, 29 june 2007", ("29 june 2007",), 0.97),
    ("lgpl-2.1", r"gnu lesser general public license version 2\.1, february 1999", ("february 1999",), 0.97),
    ("lgpl-3", r"gnu lesser general public license version 3, 29 june 2007", ("29 june 2007",), 0.97),
    ("agpl-3", r"gnu affero general public license version 3, 19 november 2007", ("19 november 2007",), 0.97),
    ("gfdl-1.3", r"gnu free documentation license version 1\.3, 3 november 2008", ("3 november 2008",), 0.97),
    ("apache-2.0", r"apache license version 2\.0, january 2004", ("january 2004",), 0.97),
    ("apache-2.0", r"grant of copyright license\. subject to the terms and conditions of this license, each contributor hereby grants", ("each contributor",), 0.9),
    ("apache-2.0", r"grant of patent license\. subject to the terms and conditions of this license", ("patent license",), 0.85),
    ("mpl-2.0", r"mozilla public license version 2\.0 1\. definitions", ("definitions",), 0.97),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", ("accompanying program",), 0.95),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", ("accompanying program",), 0.95),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", ("a package may be copied",), 0.95),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied", ("free software package",), 0.95),
    ("ms-pl", r"this license governs use of the accompanying software\. if you use the software, you accept this license", ("accompanying software",), 0.85),
    ("eupl", r"the european union public licence \(the [\"'“‘]?eupl", ("european union",), 0.95),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("anyone is free",), 0.95),
    ("wtfpl", r"you just do what the f\w+ you want to", ("you just do what",), 0.95),
    ("ofl-1.1", r"reserved font name", ("reserved font name",), 0.8),
    ("cc-by", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made", ("appropriate credit",), 0.85),
    ("cc-by-nc", r"you may not use the material for commercial purposes", ("commercial purposes",), 0.8),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original", ("same license as the original",), 0.85),
    ("cc-by-nd", r"you may not distribute the modified material", ("modified material",), 0.85),
    # exceptions and additions
    ("classpath-exception", r"gives? you permission to link this library with independent modules to produce an executable", ("independent modules",), 0.95),
    ("gcc-exception", r"gcc runtime library exception", ("runtime library",), 0.95),
    ("autoconf-exception", r"as a special exception to the gnu general public license, if you distribute this file as part of a program that contains a configuration script", ("configuration script",), 0.95),
    ("bison-exception", r"as a special exception, you may create a larger work that contains part or all of the bison parser skeleton", ("bison parser",), 0.95),
    ("font-exception", r"embed(?:s|ding)? (?:portions of )?this font .{0,80}does not by itself cause the resulting document to be covered by the gnu", ("this font",), 0.95),
    ("linking-exception", r"as a special exception, .{0,120}link(?:ing)? (?:this|the) (?:library|program|code)", ("special exception",), 0.85),
    ("openssl-exception", r"permission to link the code of portions of this program with the openssl library", ("openssl library",), 0.95),
    ("llvm-exception", r"llvm exceptions? to the apache 2\.0 license", ("llvm exception",), 0.95),
    ("linux-syscall-note", r"this copyright does \*?not\*? cover user programs that use kernel services", ("kernel services",), 0.95),
    ("universal-foss-exception", r"universal foss exception", ("foss exception",), 0.95),
    ("libtool-exception", r"if you distribute this file as part of a program or library that is built using gnu libtool", ("gnu libtool",), 0.95),
    ("swift-exception", r"runtime library exception to the apache 2\.0 license", ("runtime library",), 0.95),
    # short tags and references to files
    ("spdx", r"spdx-license-identifier: [a-z0-9][a-z0-9.+-]*(?: (?:and|or|with) [a-z0-9][a-z0-9.+-]*)*", ("spdx license identifier",), 1.0),
    ("license-file", r"see (?:the )?(?:file )?licen[cs]e(?:\.(?:txt|md|rst))? (?:file )?(?:for|in the)", ("see",), 0.6),
    ("license-file", r"(?:governed by|found in|described in) (?:a|the) (?:bsd-style |mit-style )?licen[cs]e (?:that can be found )?(?:in the licen[cs]e file)?", ("license", "licence"), 0.6),
    ("bsd", r"use of this source code is governed by a bsd-style license", ("bsd style",), 0.95),
    ("mit", r"use of this source code is governed by an mit-style license", ("mit style",), 0.95),
    ("copying-file", r"see (?:the )?(?:file )?copying(?:\.lesser|\.txt)?(?: file)? for (?:more )?(?:details|the license|copying conditions)", ("copying",), 0.6),
    ("notice-file", r"see (?:the )?notice(?:\.txt)? file distributed with this work", ("notice",), 0.7),
    ("mit", r"opensource\.org/licenses/mit(?:-license)?", ("opensource.org",), 0.95),
    ("bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause", ("opensource.org",), 0.95),
    ("bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause", ("opensource.org",), 0.95),
    ("isc", r"opensource\.org/licenses/isc", ("opensource.org",), 0.95),
    ("apache-2.0", r"apache\.org/licenses/license-2\.0", ("apache.org",), 0.95),
    ("gpl", r"gnu\.org/(?:copyleft|licenses)/gpl", ("gnu.org",), 0.9),
    ("lgpl", r"gnu\.org/(?:copyleft|licenses)/lgpl", ("gnu.org",), 0.9),
    ("agpl", r"gnu\.org/licenses/agpl", ("gnu.org",), 0.9),
    ("gfdl", r"gnu\.org/(?:copyleft|licenses)/fdl", ("gnu.org",), 0.9),
    ("mpl-2.0", r"mozilla\.org/mpl/2\.0", ("mozilla.org",), 0.95),
    ("boost-1.0", r"boost\.org/license_1_0\.txt", ("boost.org",), 0.95),
    ("unlicense", r"unlicense\.org", ("unlicense.org",), 0.95),
    ("ofl-1.1", r"scripts\.sil\.org/ofl", ("sil.org",), 0.95),
    ("odbl-1.0", r"opendatacommons\.org/licenses/odbl", ("opendatacommons",), 0.95),
    ("odc-by-1.0", r"opendatacommons\.org/licenses/by", ("opendatacommons",), 0.95),
    ("eupl", r"joinup\.ec\.europa\.eu/.{0,40}eupl", ("joinup",), 0.9),
    # dual and multiple licensing
    ("dual", r"dual[- ]licen[sc]ed under (?:the )?", ("dual",), 0.7),
    ("perl", r"artistic license and/or the gnu general public license", ("artistic",), 0.9),
    ("mit", r"licensed under (?:either )?(?:of )?(?:the )?(?:apache license.{0,60}? or )?(?:the )?mit license", ("mit license",), 0.9),
    ("apache-2.0", r"mit or apache-2\.0|apache-2\.0 or mit", ("apache 2.0",), 0.9),
    # proprietary statements and weak hints
    ("proprietary", r"proprietary and confidential", ("proprietary",), 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,60}is (?:strictly )?prohibited", ("unauthori",), 0.8),
    ("proprietary", r"may not be (?:copied|reproduced|distributed) .{0,60}without (?:the )?(?:prior |express )?written (?:permission|consent)", ("may not be",), 0.75),
    ("proprietary", r"this (?:material|software|document) is (?:the )?(?:confidential|proprietary)", ("this",), 0.75),
    ("proprietary", r"trade secrets? of", ("trade secret",), 0.5),
    ("proprietary", r"internal use only", ("internal use only",), 0.5),
    ("proprietary", r"end[- ]user licen[cs]e agreement", ("license agreement", "licence agreement"), 0.7),
    ("proprietary", r"for evaluation (?:purposes )?only", ("for evaluation",), 0.5),
    ("proprietary", r"not for (?:commercial )?(?:re)?distribution", ("not for",), 0.5),
    ("noncommercial", r"for (?:personal|academic|educational|research)(?:,? (?:and|or) (?:personal|academic|educational|research))* use only", ("use only",), 0.6),
    ("noncommercial", r"non-?commercial use only", ("commercial use only",), 0.7),
    ("noncommercial", r"free for non-?commercial use", ("commercial use",), 0.7),
    ("freeware", r"this (?:software|program) is freeware", ("freeware",), 0.7),
    ("shareware", r"this (?:software|program) is shareware", ("shareware",), 0.7),
    ("proprietary", r"all rights reserved", ("rights reserved",), 0.5),
]
