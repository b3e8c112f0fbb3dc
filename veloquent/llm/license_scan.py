"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose every place counts, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Hand-written signatures over normalised words: priority, label, keyword, pattern, confidence.
# Words are lower-case and joined by single blanks; a dotted version such as 2.0 reads "2 0".
SIGNATURES = [
    (90, "agpl-3.0", "affero", r"gnu affero general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)3(?: 0)?", 0.99),
    (90, "agpl-1.0", "affero", r"affero general public license (?:version |v)1(?: 0)?", 0.97),
    (80, "agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", 0.95),
    (70, "agpl-3.0", "agpl", r"agpl ?v?3(?: 0)?(?: or later| only)?", 0.95),
    (60, "agpl", "agpl", r"(?:gnu )?agpl(?: licen[cs]ed?)?", 0.8),
    (90, "lgpl-2.1", "lesser", r"gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)2 1", 0.99),
    (90, "lgpl-3.0", "lesser", r"gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)3(?: 0)?", 0.99),
    (90, "lgpl-2.0", "library", r"gnu library general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)2(?: 0)?", 0.99),
    (80, "lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", 0.95),
    (80, "lgpl", "library", r"gnu library general public licen[cs]e", 0.95),
    (70, "lgpl-2.1", "lgpl", r"lgpl ?v?2 1(?: or later| only| plus)?", 0.95),
    (70, "lgpl-3.0", "lgpl", r"lgpl ?v?3(?: 0)?(?: or later| only| plus)?", 0.95),
    (60, "lgpl", "lgpl", r"(?:gnu )?lgpl(?: licen[cs]ed?)?", 0.85),
    (90, "gpl-3.0", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)3(?: 0)?", 0.99),
    (90, "gpl-2.0", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)2(?: 0)?", 0.99),
    (90, "gpl-1.0", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)1(?: 0)?", 0.97),
    (92, "gpl-2.0-or-later", "general", r"gnu general public license as published by the free software foundation either version 2(?: 0)? of the license or at your option any later version", 0.99),
    (92, "gpl-3.0-or-later", "general", r"gnu general public license as published by the free software foundation either version 3(?: 0)? of the license or at your option any later version", 0.99),
    (85, "gpl-classpath", "classpath", r"classpath exception", 0.8),
    (75, "gpl", "general", r"gnu general public licen[cs]e", 0.95),
    (70, "gpl-2.0", "gpl", r"gpl ?v?2(?: 0)?(?: or later| only| plus)?", 0.93),
    (70, "gpl-3.0", "gpl", r"gpl ?v?3(?: 0)?(?: or later| only| plus)?", 0.93),
    (55, "gpl", "gpl", r"(?:under|the|gnu) gpl(?: licen[cs]e)?", 0.8),
    (90, "gfdl-1.1", "documentation", r"gnu free documentation license (?:version |v)1 1", 0.99),
    (90, "gfdl-1.2", "documentation", r"gnu free documentation license (?:version |v)1 2", 0.99),
    (90, "gfdl-1.3", "documentation", r"gnu free documentation license (?:version |v)1 3", 0.99),
    (80, "gfdl", "documentation", r"gnu free documentation licen[cs]e", 0.95),
    (60, "gfdl", "gfdl", r"gfdl", 0.75),
    (90, "apache-2.0", "apache", r"apache (?:software )?license(?: version| v)? ?2(?: 0)?", 0.99),
    (90, "apache-1.1", "apache", r"apache (?:software )?license(?: version| v)? ?1 1", 0.98),
    (90, "apache-1.0", "apache", r"apache (?:software )?license(?: version| v)? ?1 0", 0.98),
    (85, "apache-2.0", "apache", r"(?:www )?apache org licenses license 2 0", 0.99),
    (70, "apache-2.0", "apache", r"apache 2 0(?: licen[cs]ed?)?", 0.85),
    (70, "apache-2.0", "asl", r"asl ?v?2 0(?: licen[cs]ed?)?", 0.85),
    (75, "apache", "apache", r"apache (?:software )?licen[cs]e", 0.93),
    (65, "apache", "apache", r"licensed to the apache software foundation", 0.93),
    (95, "mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.99),
    (75, "mit", "mit", r"(?:the )?mit licen[cs]e", 0.95),
    (80, "mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", 0.96),
    (70, "mit", "mit", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit", 0.9),
    (70, "x11", "x11", r"x11 licen[cs]e", 0.9),
    (70, "x11", "consortium", r"x consortium licen[cs]e", 0.9),
    (60, "expat", "expat", r"expat licen[cs]e", 0.9),
    (95, "isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.98),
    (75, "isc", "isc", r"isc licen[cs]e", 0.93),
    (94, "bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    (85, "bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?", 0.95),
    (85, "bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?", 0.95),
    (85, "bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?", 0.95),
    (85, "0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[cs]e)?|0bsd", 0.93),
    (85, "0bsd", "free", r"free public licen[cs]e(?: 1 0 0)?", 0.9),
    (75, "bsd", "bsd", r"bsd(?: style| type)? licen[cs]ed?", 0.9),
    (90, "mpl-1.0", "mozilla", r"mozilla public license(?: version| v)? ?1 0", 0.98),
    (90, "mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? ?1 1", 0.98),
    (90, "mpl-2.0", "mozilla", r"mozilla public license(?: version| v)? ?2 0", 0.99),
    (92, "mpl-2.0", "mozilla", r"subject to the terms of the mozilla public license v 2 0", 0.99),
    (75, "mpl", "mozilla", r"mozilla public licen[cs]e", 0.93),
    (65, "mpl-2.0", "mpl", r"mpl ?v?2(?: 0)?", 0.9),
    (65, "mpl-1.1", "mpl", r"mpl ?v?1 1", 0.9),
    (60, "npl", "netscape", r"netscape public licen[cs]e", 0.93),
    (90, "epl-1.0", "eclipse", r"eclipse public license(?: version| v)? ?1 0", 0.98),
    (90, "epl-2.0", "eclipse", r"eclipse public license(?: version| v)? ?2 0", 0.98),
    (75, "epl", "eclipse", r"eclipse public licen[cs]e", 0.93),
    (70, "edl", "eclipse", r"eclipse distribution licen[cs]e", 0.93),
    (80, "cddl-1.0", "distribution", r"common development and distribution license(?: cddl)?(?: version| v)? ?1 0", 0.98),
    (80, "cddl-1.1", "distribution", r"common development and distribution license(?: cddl)?(?: version| v)? ?1 1", 0.98),
    (75, "cddl", "distribution", r"common development and distribution licen[cs]e", 0.95),
    (60, "cddl", "cddl", r"cddl(?: licen[cs]ed?)?", 0.85),
    (75, "cpl-1.0", "common", r"common public license(?: version| v)?(?: ?1 0)?", 0.93),
    (75, "cpal-1.0", "attribution", r"common public attribution licen[cs]e", 0.93),
    (75, "ibm-pl", "ibm", r"ibm public licen[cs]e", 0.93),
    (75, "artistic-1.0", "artistic", r"artistic license(?: version| v)? ?1 0", 0.96),
    (75, "artistic-2.0", "artistic", r"artistic license(?: version| v)? ?2 0", 0.97),
    (70, "artistic", "artistic", r"artistic licen[cs]e", 0.85),
    (75, "perl", "perl", r"under the same terms as perl itself", 0.9),
    (75, "python-2.0", "python", r"python (?:software foundation )?licen[cs]e(?: version| v)?(?: ?2(?: 0)?)?", 0.9),
    (75, "psf", "psf", r"psf licen[cs]e", 0.9),
    (75, "php-3.01", "php", r"php license(?: version| v)? ?3 01", 0.95),
    (70, "php", "php", r"php licen[cs]e", 0.85),
    (75, "ruby", "ruby", r"(?:ruby s licen[cs]e|ruby licen[cs]e)", 0.85),
    (75, "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 0.93),
    (90, "zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    (75, "libpng", "libpng", r"libpng licen[cs]e", 0.9),
    (75, "bsl-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?", 0.97),
    (75, "busl-1.1", "business", r"business source license(?: version)?(?: 1 1)?", 0.95),
    (75, "sspl-1.0", "server", r"server side public license(?: version| v)?(?: ?1)?", 0.95),
    (75, "elastic-2.0", "elastic", r"elastic license(?: version)?(?: 2 0)?", 0.93),
    (75, "commons-clause", "commons", r"commons clause(?: license)?(?: condition)?", 0.9),
    (75, "polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) license", 0.95),
    (90, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.99),
    (70, "unlicense", "unlicense", r"(?:the unlicense|unlicense org)", 0.9),
    (75, "wtfpl", "wtfpl", r"wtfpl", 0.95),
    (80, "wtfpl", "want", r"do what the fuck you want to public licen[cs]e", 0.99),
    (75, "beerware", "beer", r"beer ?ware licen[cs]e", 0.93),
    (75, "json", "evil", r"the software shall be used for good not evil", 0.98),
    (75, "ms-pl", "microsoft", r"microsoft public licen[cs]e", 0.95),
    (75, "ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", 0.95),
    (75, "apsl", "apple", r"apple public source licen[cs]e", 0.95),
    (75, "osl-3.0", "open", r"open software license(?: version| v)?(?: ?3 0)?", 0.9),
    (75, "afl-3.0", "academic", r"academic free license(?: version| v)?(?: ?3 0)?", 0.9),
    (75, "ecl-2.0", "educational", r"educational community license(?: version)?(?: 2 0)?", 0.93),
    (75, "eupl", "european", r"european union public licen[cs]e", 0.95),
    (80, "eupl-1.2", "european", r"european union public license(?: version| v)? ?1 2", 0.98),
    (65, "eupl", "eupl", r"eupl", 0.85),
    (75, "cecill", "cecill", r"cecill(?: b| c)?(?: licen[cs]e)?", 0.9),
    (75, "qpl", "public", r"q public licen[cs]e", 0.93),
    (75, "upl-1.0", "universal", r"universal permissive licen[cs]e", 0.95),
    (75, "ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e", 0.93),
    (75, "mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)", 0.95),
    (75, "w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e", 0.93),
    (75, "ofl-1.1", "font", r"sil open font license(?: version)?(?: 1 1)?", 0.97),
    (75, "ofl", "font", r"open font licen[cs]e", 0.9),
    (75, "unicode", "unicode", r"unicode (?:inc )?licen[cs]e agreement", 0.93),
    (75, "openssl", "openssl", r"openssl licen[cs]e", 0.93),
    (75, "curl", "curl", r"curl licen[cs]e", 0.85),
    (75, "vim", "vim", r"vim licen[cs]e", 0.85),
    (75, "postgresql", "postgresql", r"postgresql licen[cs]e", 0.93),
    (75, "odbl-1.0", "database", r"open (?:data commons open )?database license(?: odbl)?(?: v ?1 0)?", 0.95),
    (75, "odc-by", "commons", r"open data commons attribution licen[cs]e", 0.95),
    (75, "pddl", "dedication", r"public domain dedication and licen[cs]e", 0.95),
    (75, "ogl-uk", "government", r"open government licen[cs]e", 0.93),
    (75, "openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: ?m)?(?: licen[cs]e)?", 0.9),
    (75, "openrail", "rail", r"(?:creativeml |bigscience )?open rail(?: m)?(?: licen[cs]e)?", 0.9),
    (75, "llama", "llama", r"llama(?: ?[234])?(?: [123])? community licen[cs]e", 0.93),
    (91, "agpl-3.0-or-later", "affero", r"gnu affero general public license as published by the free software foundation either version 3(?: 0)? of the license or at your option any later version", 0.99),
    (71, "agpl-3.0-only", "agpl", r"agpl ?v?3(?: 0)? only", 0.95),
    (91, "lgpl-2.1-or-later", "lesser", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", 0.99),
    (91, "lgpl-3.0-or-later", "lesser", r"gnu lesser general public license as published by the free software foundation either version 3(?: 0)? of the license or at your option any later version", 0.99),
    (71, "gpl-2.0-only", "gpl", r"gpl ?v?2(?: 0)? only", 0.95),
    (71, "gpl-3.0-only", "gpl", r"gpl ?v?3(?: 0)? only", 0.95),
    (85, "gpl-font-exception", "font", r"(?:gpl )?font exception", 0.8),
    (85, "gpl-linking-exception", "linking", r"(?:gpl |static )?linking exception", 0.8),
    (85, "gcc-exception", "runtime", r"gcc runtime library exception", 0.95),
    (85, "autoconf-exception", "autoconf", r"autoconf (?:configure script )?exception", 0.9),
    (85, "bison-exception", "bison", r"bison exception", 0.9),
    (80, "gpl", "copyleft", r"copyleft(?:ed)? under the gpl", 0.8),
    (70, "gpl", "copying", r"see the file copying for (?:details|license)", 0.5),
    (88, "apache-2.0", "apache", r"dual licensed under (?:the )?apache(?: license)?(?: version)? 2 0 and (?:the )?mit", 0.95),
    (66, "llvm-exception", "llvm", r"(?:apache 2 0 with )?llvm exceptions?", 0.93),
    (76, "mit", "expat", r"mit expat licen[cs]e", 0.93),
    (76, "mit-cmu", "cmu", r"cmu (?:mit )?licen[cs]e", 0.85),
    (76, "mit-modern", "modern", r"modern mit licen[cs]e", 0.85),
    (76, "hpnd", "historical", r"historical permission notice and disclaimer", 0.95),
    (86, "hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", 0.9),
    (76, "icu", "icu", r"icu licen[cs]e", 0.85),
    (76, "bsd-3-clause-clear", "bsd", r"(?:clear bsd|bsd 3 clause clear)(?: licen[cs]e)?", 0.95),
    (76, "bsd-1-clause", "bsd", r"(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?", 0.93),
    (76, "bsd-patent", "bsd", r"bsd (?:2 clause )?plus patent(?: licen[cs]e)?", 0.93),
    (76, "bsd-source-code", "bsd", r"bsd source code attribution", 0.9),
    (76, "intel-osl", "intel", r"intel open source licen[cs]e", 0.93),
    (76, "intel-simplified", "intel", r"intel simplified software licen[cs]e", 0.93),
    (76, "nvidia", "nvidia", r"nvidia (?:software|source code|open model) licen[cs]e", 0.9),
    (76, "amd", "amd", r"amd software licen[cs]e", 0.85),
    (76, "ipl-1.0", "ibm", r"ibm public license(?: version)? 1 0", 0.95),
    (76, "sun-isl", "sun", r"sun industry standards source licen[cs]e", 0.95),
    (76, "spl-1.0", "sun", r"sun public licen[cs]e", 0.93),
    (76, "sleepycat", "sleepycat", r"sleepycat licen[cs]e", 0.93),
    (76, "nokia", "nokia", r"nokia open source licen[cs]e", 0.93),
    (76, "motosoto", "motosoto", r"motosoto open source licen[cs]e", 0.93),
    (76, "naumen", "naumen", r"naumen public licen[cs]e", 0.93),
    (76, "ngpl", "nethack", r"nethack general public licen[cs]e", 0.95),
    (76, "oclc-2.0", "oclc", r"oclc research public licen[cs]e", 0.93),
    (76, "opl", "opencontent", r"opencontent licen[cs]e", 0.9),
    (76, "open-publication", "publication", r"open publication licen[cs]e", 0.93),
    (76, "rpl-1.5", "reciprocal", r"reciprocal public licen[cs]e(?: 1 5)?", 0.95),
    (76, "ricoh", "ricoh", r"ricoh source code public licen[cs]e", 0.93),
    (76, "rpsl", "realnetworks", r"realnetworks public source licen[cs]e", 0.93),
    (76, "simpl-2.0", "simple", r"simple public licen[cs]e(?: 2 0)?", 0.9),
    (76, "sugarcrm", "sugarcrm", r"sugarcrm public licen[cs]e", 0.93),
    (76, "tcp-wrappers", "wrappers", r"tcp wrappers licen[cs]e", 0.9),
    (76, "vsl-1.0", "vovida", r"vovida software licen[cs]e", 0.93),
    (76, "watcom", "sybase", r"sybase open watcom public licen[cs]e", 0.95),
    (76, "wxwindows", "wxwindows", r"wxwindows library licen[cs]e", 0.95),
    (76, "xnet", "x", r"x net licen[cs]e", 0.85),
    (76, "zpl", "zope", r"zope public licen[cs]e(?: version)?(?: 2 [01])?", 0.95),
    (76, "entessa", "entessa", r"entessa public licen[cs]e", 0.93),
    (76, "eudatagrid", "datagrid", r"eu datagrid software licen[cs]e", 0.93),
    (76, "fair", "fair", r"fair licen[cs]e", 0.75),
    (76, "frameworx", "frameworx", r"frameworx (?:open )?licen[cs]e", 0.93),
    (76, "lucent", "lucent", r"lucent public licen[cs]e", 0.93),
    (76, "miros", "miros", r"miros licen[cs]e", 0.9),
    (76, "multics", "multics", r"multics licen[cs]e", 0.9),
    (76, "nasa", "nasa", r"nasa open source agreement", 0.95),
    (76, "ntp", "ntp", r"ntp licen[cs]e", 0.85),
    (76, "latex", "latex", r"latex project public licen[cs]e(?: 1 3c?)?", 0.96),
    (66, "latex", "lppl", r"lppl", 0.85),
    (76, "attribution-assurance", "assurance", r"attribution assurance licen[cs]e", 0.93),
    (76, "cua-opl", "cua", r"cua office public licen[cs]e", 0.93),
    (76, "efl-2.0", "eiffel", r"eiffel forum licen[cs]e", 0.93),
    (76, "liliq", "quebec", r"licence libre du quebec", 0.9),
    (76, "etalab", "etalab", r"licence ouverte(?: etalab)?|etalab (?:open )?licen[cs]e", 0.9),
    (76, "dl-de-by", "datenlizenz", r"datenlizenz deutschland(?: namensnennung)?(?: (?:version )?2 0)?", 0.95),
    (76, "cdla-permissive", "community", r"community data license agreement permissive(?: version)?(?: [12] 0)?", 0.96),
    (76, "cdla-sharing", "community", r"community data license agreement sharing(?: version)?(?: 1 0)?", 0.96),
    (76, "o-uda", "data", r"open use of data agreement", 0.93),
    (76, "c-uda", "computational", r"computational use of data agreement", 0.93),
    (76, "gemma", "gemma", r"gemma terms of use", 0.93),
    (76, "falcon", "falcon", r"(?:tii )?falcon (?:llm )?licen[cs]e", 0.9),
    (76, "deepseek", "deepseek", r"deepseek (?:model )?licen[cs]e(?: agreement)?", 0.9),
    (76, "qwen", "qwen", r"(?:tongyi )?qwen (?:research )?licen[cs]e(?: agreement)?", 0.9),
    (76, "confluent", "confluent", r"confluent community licen[cs]e", 0.95),
    (76, "timescale", "timescale", r"timescale licen[cs]e", 0.93),
    (76, "fsl", "functional", r"functional source licen[cs]e", 0.95),
    (76, "blueoak", "blue", r"blue oak model licen[cs]e", 0.95),
    (76, "hippocratic", "hippocratic", r"hippocratic licen[cs]e", 0.95),
    (76, "parity", "parity", r"parity public licen[cs]e", 0.95),
    (76, "prosperity", "prosperity", r"prosperity public licen[cs]e", 0.95),
    (76, "ofl-1.0", "font", r"sil open font license(?: version)? 1 0", 0.97),
    (76, "bitstream-vera", "vera", r"bitstream vera (?:fonts )?(?:copyright|licen[cs]e)", 0.93),
    (76, "ubuntu-font", "ubuntu", r"ubuntu font licen[cs]e", 0.95),
    (76, "cern-ohl", "cern", r"cern open hardware licen[cs]e(?: version)?(?: [12](?: [02])?)?", 0.95),
    (76, "tapr-ohl", "tapr", r"tapr open hardware licen[cs]e", 0.95),
    (76, "solderpad", "solderpad", r"solderpad (?:hardware )?licen[cs]e", 0.95),
    (76, "glide", "glide", r"3dfx glide (?:source code )?(?:general public )?licen[cs]e", 0.93),
    (76, "jython", "jython", r"jython licen[cs]e", 0.9),
    (76, "tcl", "tcl", r"tcl tk licen[cs]e", 0.9),
    (76, "imagemagick", "imagemagick", r"imagemagick licen[cs]e", 0.93),
    (76, "info-zip", "zip", r"info zip licen[cs]e", 0.93),
    (76, "bzip2", "bzip2", r"bzip2 (?:and libbzip2 )?licen[cs]e", 0.9),
    (76, "ijg", "jpeg", r"independent jpeg group(?: licen[cs]e)?", 0.85),
    (76, "freetype", "freetype", r"freetype (?:project )?licen[cs]e", 0.93),
    (76, "oracle-bcl", "oracle", r"oracle binary code licen[cs]e", 0.93),
    (76, "otn", "oracle", r"oracle technology network licen[cs]e", 0.93),
    (85, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.95),
    (85, "cc0-1.0", "zero", r"creative commons zero(?: v?1 0)?(?: universal)?", 0.95),
    (60, "cc", "creative", r"creative commons(?: public)? licen[cs]e", 0.85),
    (85, "cc-pdm", "domain", r"creative commons public domain mark", 0.93),
    (50, "public-domain", "domain", r"(?:released|placed|is|are) (?:into|in) the public domain", 0.8),
    (45, "all-rights-reserved", "rights", r"all rights reserved", 0.6),
    (40, "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.5),
    (45, "proprietary", "proprietary", r"proprietary and confidential", 0.8),
    (45, "proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution) (?:of this (?:file|software|work) )?is strictly prohibited", 0.85),
    (45, "proprietary", "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced", 0.85),
    (40, "no-commercial-use", "commercial", r"for (?:personal and )?non ?commercial use only", 0.7),
    (40, "no-derivatives", "derivative", r"no derivative works? (?:may be|are) (?:made|permitted|allowed)", 0.7),
    (30, "eula", "end", r"end user licen[cs]e agreement", 0.8),
    (30, "terms-of-use", "terms", r"subject to (?:the|our) terms of (?:use|service)", 0.5),
    (20, "license-notice", "license", r"(?:licensed|released|distributed) under the (?:terms of the )?(?:following )?licen[cs]e", 0.5),
]

# Notices told apart by what follows them anywhere before the next such notice: a signature's pattern, then the second half.
TWO_HALVES = [
    (97, "bsd-4-clause", "redistribution", r"redistribution and use in source and binary forms", 0.97, r"all advertising materials mentioning features"),
    (96, "bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms", 0.97, r"neither the names? of"),
    (97, "mit-no-endorsement", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0.9, r"shall not be used in advertising or otherwise to promote the sale"),
]

# The Creative Commons families; versions and wordings follow by rule.
CC_TERMS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


@dataclass(frozen=True)
class Signature:
    """A rule over normalised words; smaller ``order`` is checked first."""

    order: int
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    confidence: float
    then: re.Pattern | None = None

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of the pattern; if there is a second half, those that it follows before the pattern's next place."""
        places = [m.span() for m in self.pattern.finditer(text)]
        if not self.then or not places:
            yield from places
            return
        seconds = [m.start() for m in self.then.finditer(text)]
        for (a, b), limit in zip(places, [a for a, _ in places[1:]] + [len(text)]):
            at = bisect_left(seconds, b - 1)
            if at < len(seconds) and seconds[at] < limit:
                yield a, b


@lru_cache(1)
def signatures() -> tuple[Signature, ...]:
    """All rules in order: higher priority first, then as written."""
    rows = [(*r, None) for r in SIGNATURES] + TWO_HALVES
    between = r"(?: (?:international|unported|generic|public|licen[cs]e|version|v|the))*"
    for code, words in CC_TERMS.items():
        short = code.replace("-", " ")
        for version in CC_VERSIONS:
            rows.append((88, f"cc-{code}-{version.replace(' ', '.')}", "cc", rf"cc {short} {version}", 0.97, None))
            rows.append((88, f"cc-{code}-{version.replace(' ', '.')}", "creative", rf"creative commons {words}{between} {version}(?: international| unported| generic)?", 0.97, None))
            rows.append((88, f"cc-{code}-{version.replace(' ', '.')}", "creativecommons", rf"creativecommons org licenses {short} {version}", 0.99, None))
        rows.append((78, f"cc-{code}", "cc", rf"cc {short}", 0.9, None))
        rows.append((78, f"cc-{code}", "creative", rf"creative commons {words}", 0.93, None))
    rows.sort(key=lambda r: -r[0])
    whole = lambda x: re.compile(f"(?<= )(?:{x})(?= )") if x else None
    return tuple(Signature(i, p, label, key, whole(pattern), c, whole(then)) for i, (p, label, key, pattern, c, then) in enumerate(rows))


@lru_cache(1)
def _gates() -> tuple[re.Pattern, dict[str, tuple[Signature, ...]]]:
    by_key: dict[str, list[Signature]] = {}
    for s in signatures():
        by_key.setdefault(s.keyword, []).append(s)
    return tuple(sorted(by_key)), {k: tuple(v) for k, v in by_key.items()}


#: Bytes that separate words, as a translation to blanks; words are 0-9, a-z and all beyond ASCII.
_BLANK = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normalise(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANK).split()


def resolve(found: list[tuple[int, int, Signature]]) -> list[tuple[int, int, Signature]]:
    """Detections ``(start, end, rule)`` that survive: none inside or across one of higher rank.

    Rank is priority, then length, then the rule's order. One contained in a survivor goes, and so
    does one that overlaps a survivor partly.
    """
    kept: list[tuple[int, int, Signature]] = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[2].order, d[0])):
        if all(end <= a or b <= start for a, b, _ in kept):
            kept.append((start, end, rule))
    return sorted(kept, key=lambda d: d[:2])


def _stretches(found: list[tuple[int, int, Signature]]) -> Iterator[list[tuple[int, int, Signature]]]:
    """Groups of detections that overlap in a chain, in text order."""
    group, end = [], -1
    for d in sorted(found, key=lambda d: d[:2]):
        if group and d[0] >= end:
            yield group
            group = []
        end = max(end, d[1]) if group else d[1]
        group.append(d)
    if group:
        yield group


def scan(text: str | None) -> tuple[int, int, int | None, int | None, set[str], list[tuple[int, int, str, float]]]:
    """``(n_words, n_base, first_word, last_word, base labels, detections)`` of one text.

    Detections are ``(first word, word after the last, label, confidence)`` after suppression.
    """
    words = normalise(text)
    joined = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in BASE_PHRASES.items():
        needle = f" {phrase} ".encode()
        at = joined.find(needle)
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = joined.find(needle, at + 1)
    keys, rules = _gates()
    hits = [k for k in keys if k.encode() in joined]
    detected: list[tuple[int, int, str, float]] = []
    if hits:
        readable = joined.decode("utf-8", "replace")
        found = [(*span, rule) for k in hits for rule in rules[k] for span in rule.matches(readable)]
        done = word = 0
        for group in _stretches(found):
            for start, end, rule in resolve(group):
                word += readable.count(" ", done, start)
                done = start
                detected.append((word - 1, word + readable.count(" ", start, end), rule.label, rule.confidence))
    at = sorted({joined.count(b" ", 0, s) for s in ((min(starts), max(starts)) if starts else ())})
    return len(words), len(starts), (at[0] if at else None), (at[-1] if at else None), base, detected


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "detections array<struct<first: bigint, after: bigint, label: string, confidence: double>>"
)
_DETECTED = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts, labels, score and the surviving detections.

    A null text counts as empty: no words, no labels, score zero. The score is the chance that at
    least one detection is right. Base labels always stay, whatever the signatures find. Texts of any length are scanned
    whole, repeated rows each; an empty table gives an empty result; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                n, n_base, first, last, base, detected = scan(text.as_py())
                labels = base | {d[2] for d in detected}
                wrong = 1.0
                for c in [d[3] for d in detected] or [0.9] * bool(base):
                    wrong *= 1 - c
                out.append((n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - wrong, detected))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            spans = pa.array([[{"first": a, "after": b, "label": x, "confidence": c} for a, b, x, c in d] for d in columns[7]], _DETECTED)
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, spans], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
