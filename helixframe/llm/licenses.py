"""License scan by ordered signature rules, in DataFrame functions only.

A text's words are its runs of ASCII letters, digits and non-ASCII characters; matching ignores
the case of A-Z.  The base is the places of four fixed phrases.  The method adds signature rules:
hand-written patterns over the text's words joined by single spaces, each with a priority (lower is stronger) and
each tried only where the text holds the pattern's keywords: the words that all of its spellings
share, worked out from the pattern itself, so that no match is lost.  Where
detections overlap, one whose interval lies inside another's of the same or a stronger priority is
suppressed; of equal intervals the stronger rule's stays.  Base labels always stay.  Time grows with
the text's length and with the number of detections times its logarithm.

The score is 1 - product(1 - confidence) over the labels that remain, 0 without any.

Defined results: a null text counts as empty: no words, labels '' and score 0; repeated rows and
null ids keep their rows; very long texts are scanned whole; no rows give no rows; only the id and
the text are looked at, so other columns can have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import before, ends, let, running
from ._common import documents

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    confidence: float


#: Hand-written signatures: label, pattern over single-spaced words, priority (lower is stronger), confidence.
WRITTEN = [
    ("gpl-3.0", r"gnu general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)?", 20, 0.98),
    ("gpl-2.0", r"gnu general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?2(?: 0)?", 20, 0.98),
    ("gpl-1.0", r"gnu general public license v(?:ersion)? ?1(?: 0)?", 20, 0.95),
    ("gpl-or-later", r"gnu general public license (?:[a-z0-9]+ ){1,20}or (?:at your option )?any later version", 10, 0.98),
    ("gpl", r"gnu gpl", 40, 0.9),
    ("gpl", r"licensed under the (?:terms of the )?general public license", 40, 0.85),
    ("gpl", r"this program is free software you can redistribute it and or modify it", 35, 0.95),
    ("gpl", r"copyleft license", 60, 0.5),
    ("lgpl-2.1", r"gnu lesser general public license v(?:ersion)? ?2 1", 10, 0.98),
    ("lgpl-3.0", r"gnu lesser general public license v(?:ersion)? ?3(?: 0)?", 10, 0.98),
    ("lgpl", r"gnu lesser general public license", 25, 0.95),
    ("lgpl-2.0", r"gnu library general public license(?: v(?:ersion)? ?2(?: 0)?)?", 10, 0.97),
    ("lgpl", r"lgpl(?: licensed)?", 50, 0.8),
    ("agpl-3.0", r"gnu affero general public license(?: v(?:ersion)? ?3(?: 0)?)?", 10, 0.98),
    ("agpl-1.0", r"affero general public license v(?:ersion)? ?1(?: 0)?", 12, 0.95),
    ("agpl", r"affero general public license", 25, 0.9),
    ("fdl-1.3", r"gnu free documentation license v(?:ersion)? ?1 3", 10, 0.97),
    ("fdl-1.2", r"gnu free documentation license v(?:ersion)? ?1 2", 10, 0.97),
    ("fdl", r"gnu free documentation license", 25, 0.95),
    ("apache-2.0", r"(?:licensed under the )?apache license v(?:ersion)? ?2(?: 0)?", 10, 0.99),
    ("apache-2.0", r"apache ?2(?: 0)?(?: license)?", 30, 0.8),
    ("apache-1.1", r"apache (?:software )?license v(?:ersion)? ?1 1", 10, 0.97),
    ("apache-1.0", r"apache (?:software )?license v(?:ersion)? ?1 0", 10, 0.97),
    ("apache", r"apache software license", 30, 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the license", 30, 0.9),
    ("mit", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit(?: license| licence)?", 10, 0.98),
    ("mit", r"the mit licen[sc]e(?: mit)?", 20, 0.97),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 10, 0.97),
    ("mit", r"deal in the software without restriction", 40, 0.9),
    ("mit-0", r"mit no attribution", 8, 0.97),
    ("x11", r"x11 licen[sc]e", 20, 0.95),
    ("expat", r"expat licen[sc]e", 20, 0.95),
    ("isc", r"isc licen[sc]e", 15, 0.97),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 10, 0.97),
    ("bsd-2-clause", r"bsd 2 clause(?: simplified)?(?: licen[sc]e)?", 10, 0.98),
    ("bsd-2-clause", r"simplified bsd licen[sc]e", 10, 0.97),
    ("bsd-2-clause", r"freebsd licen[sc]e", 12, 0.95),
    ("bsd-3-clause", r"bsd 3 clause(?: new)?(?: or)?(?: revised)?(?: licen[sc]e)?", 10, 0.98),
    ("bsd-3-clause", r"(?:new|revised|modified) bsd licen[sc]e", 10, 0.97),
    ("bsd-3-clause", r"neither the name of (?:[a-z0-9]+ ){1,12}nor the names of its contributors may be used", 15, 0.95),
    ("bsd-4-clause", r"bsd 4 clause(?: original)?(?: licen[sc]e)?", 10, 0.97),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", 12, 0.95),
    ("0bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[sc]e)?", 8, 0.97),
    ("bsd", r"bsd (?:style )?licen[sc]e", 40, 0.9),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 35, 0.9),
    ("mpl-2.0", r"mozilla public licen[sc]e v(?:ersion)? ?2(?: 0)?", 10, 0.98),
    ("mpl-1.1", r"mozilla public licen[sc]e v(?:ersion)? ?1 1", 10, 0.98),
    ("mpl-1.0", r"mozilla public licen[sc]e v(?:ersion)? ?1 0", 10, 0.98),
    ("mpl", r"mozilla public licen[sc]e", 30, 0.93),
    ("epl-2.0", r"eclipse public licen[sc]e v(?:ersion)? ?2(?: 0)?", 10, 0.98),
    ("epl-1.0", r"eclipse public licen[sc]e v(?:ersion)? ?1(?: 0)?", 10, 0.98),
    ("epl", r"eclipse public licen[sc]e", 30, 0.93),
    ("cddl-1.0", r"cddl(?: v(?:ersion)?)? ?1(?: 0)?", 15, 0.95),
    ("cddl", r"common development and distribution licen[sc]e(?: cddl)?", 20, 0.96),
    ("cpl-1.0", r"common public licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?", 20, 0.95),
    ("ibm-pl-1.0", r"ibm public licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?", 20, 0.95),
    ("artistic-2.0", r"artistic licen[sc]e v?(?:ersion )?2(?: 0)?", 10, 0.97),
    ("artistic-1.0", r"artistic licen[sc]e v?(?:ersion )?1(?: 0)?", 10, 0.96),
    ("artistic", r"artistic licen[sc]e", 30, 0.9),
    ("bsl-1.0", r"boost software licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?", 10, 0.98),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", 15, 0.97),
    ("zlib", r"altered source versions must be plainly marked as such", 15, 0.95),
    ("libpng", r"libpng licen[sc]e", 15, 0.95),
    ("curl", r"curl licen[sc]e", 20, 0.9),
    ("openssl", r"openssl licen[sc]e", 15, 0.96),
    ("ssleay", r"ssleay licen[sc]e", 15, 0.95),
    ("php-3.01", r"php licen[sc]e v(?:ersion)? ?3 01", 10, 0.97),
    ("php-3.0", r"php licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?", 20, 0.93),
    ("python-2.0", r"python (?:software foundation )?licen[sc]e(?: v(?:ersion)? ?2(?: 0)?)?", 20, 0.94),
    ("ruby", r"ruby licen[sc]e", 20, 0.93),
    ("unicode", r"unicode (?:inc )?licen[sc]e(?: agreement)?", 20, 0.93),
    ("w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e", 20, 0.94),
    ("ofl-1.1", r"sil open font licen[sc]e(?: v(?:ersion)? ?1 1)?", 10, 0.98),
    ("ofl", r"open font licen[sc]e", 30, 0.9),
    ("unlicense", r"(?:the )?unlicense", 20, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 8, 0.98),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 30, 0.9),
    ("wtfpl", r"wtfpl", 20, 0.95),
    ("wtfpl", r"do what the [a-z]+ you want to public licen[sc]e", 10, 0.97),
    ("beerware", r"beerware licen[sc]e", 20, 0.93),
    ("postgresql", r"postgresql licen[sc]e", 15, 0.96),
    ("ncsa", r"university of illinois (?:ncsa )?open source licen[sc]e", 15, 0.96),
    ("afl-3.0", r"academic free licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?", 15, 0.95),
    ("osl-3.0", r"open software licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?", 15, 0.94),
    ("ms-pl", r"microsoft public licen[sc]e(?: ms pl)?", 15, 0.95),
    ("ms-rl", r"microsoft reciprocal licen[sc]e(?: ms rl)?", 15, 0.95),
    ("eupl-1.2", r"european union public licen[sc]e(?: eupl)?(?: v(?:ersion)? ?1 2)?", 15, 0.95),
    ("cecill-2.1", r"cecill(?: free software licen[sc]e)?(?: v(?:ersion)? ?2 1)?", 20, 0.93),
    ("odbl-1.0", r"open database licen[sc]e(?: odbl)?(?: v?1(?: 0)?)?", 15, 0.96),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e(?: v?1(?: 0)?)?", 15, 0.96),
    ("pddl-1.0", r"(?:open data commons )?public domain dedication and licen[sc]e", 15, 0.95),
    ("bsl-1.1", r"business source licen[sc]e(?: v?(?:ersion )?1 1)?", 15, 0.95),
    ("sspl-1.0", r"server side public licen[sc]e(?: v?(?:ersion )?1)?", 15, 0.95),
    ("elastic-2.0", r"elastic licen[sc]e(?: v?(?:ersion )?2(?: 0)?)?", 15, 0.95),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", 15, 0.95),
    ("cc0-1.0", r"cc zero", 20, 0.9),
    ("cc0-1.0", r"creative commons zero(?: v?1 0)?(?: universal)?", 10, 0.97),
    ("proprietary", r"all rights reserved", 70, 0.6),
    ("proprietary", r"proprietary and confidential", 60, 0.85),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", 40, 0.95),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 80, 0.5),
    ("no-warranty", r"the software is provided as is without warranty of any kind", 80, 0.5),
    ("no-warranty", r"without even the implied warranty of merchantability", 80, 0.5),
    ("gpl-3.0", r"gplv3", 30, 0.85),
    ("gpl-2.0", r"gplv2", 30, 0.85),
    ("gpl-3.0", r"gpl v(?:ersion)? ?3(?: 0)?", 30, 0.85),
    ("gpl-2.0", r"gpl v(?:ersion)? ?2(?: 0)?", 30, 0.85),
    ("gpl", r"you should have received a copy of the gnu general public license", 34, 0.95),
    ("gpl", r"released under the (?:terms of the )?gnu (?:gpl|general public license)", 34, 0.95),
    ("gpl-classpath", r"gpl(?: v(?:ersion)? ?2)?(?: 0)? with (?:the )?classpath exception", 8, 0.97),
    ("gpl-classpath", r"linking this library statically or dynamically with other modules is making a combined work", 12, 0.95),
    ("gcc-exception-3.1", r"gcc runtime library exception(?: v(?:ersion)? ?3 1)?", 10, 0.96),
    ("linux-syscall-note", r"linux syscall note", 12, 0.94),
    ("lgpl-2.1", r"lgplv2 1", 30, 0.85),
    ("lgpl-3.0", r"lgplv3", 30, 0.85),
    ("agpl-3.0", r"agplv3", 30, 0.85),
    ("agpl", r"agpl licen[sc]ed?", 45, 0.8),
    ("apache-2.0", r"apache org licenses license 2 0", 10, 0.98),
    ("apache", r"the apache software foundation", 65, 0.5),
    ("llvm-exception", r"apache licen[sc]e v(?:ersion)? ?2 0 with llvm exceptions?", 5, 0.98),
    ("llvm-exception", r"llvm exceptions? to the apache 2 0 licen[sc]e", 10, 0.96),
    ("commons-clause", r"commons clause(?: licen[sc]e)?(?: condition)?(?: v1 0)?", 15, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 20, 0.96),
    ("mit", r"mit x11 licen[sc]e", 18, 0.95),
    ("mit", r"licen[sc]e mit", 45, 0.85),
    ("mit", r"opensource org licenses mit", 15, 0.96),
    ("mit-modern", r"modern mit licen[sc]e", 10, 0.94),
    ("bsd-3-clause", r"opensource org licenses bsd 3 clause", 8, 0.97),
    ("bsd-2-clause", r"opensource org licenses bsd 2 clause", 8, 0.97),
    ("bsd-3-clause-clear", r"(?:bsd 3 clause clear|clear bsd)(?: licen[sc]e)?", 8, 0.96),
    ("bsd-1-clause", r"bsd 1 clause(?: licen[sc]e)?", 10, 0.95),
    ("bsd-patent", r"bsd 2 clause plus patent(?: licen[sc]e)?", 8, 0.96),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 36, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 36, 0.9),
    ("bsd", r"this software is provided by the copyright holders and contributors as is", 45, 0.85),
    ("bsd", r"licensed under the (?:terms of the )?bsd", 42, 0.85),
    ("isc", r"opensource org licenses isc", 15, 0.95),
    ("hpnd", r"historical permission notice and disclaimer", 10, 0.95),
    ("ntp", r"ntp licen[sc]e", 15, 0.94),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0", 5, 0.99),
    ("mpl-2.0", r"mozilla org mpl 2 0", 12, 0.96),
    ("mpl-2.0", r"mplv2(?: 0)?", 30, 0.85),
    ("npl-1.1", r"netscape public licen[sc]e(?: v(?:ersion)? ?1 1)?", 15, 0.94),
    ("sun-pl-1.0", r"sun public licen[sc]e(?: v(?:ersion)? ?1 0)?", 15, 0.94),
    ("sissl", r"sun industry standards source licen[sc]e", 12, 0.95),
    ("epl-2.0", r"eclipse org legal epl 2 0", 10, 0.97),
    ("epl-2.0", r"eclipse org legal epl v20", 10, 0.97),
    ("epl-1.0", r"eclipse org legal epl v10", 10, 0.97),
    ("edl-1.0", r"eclipse distribution licen[sc]e(?: v(?:ersion)? ?1 0)?", 10, 0.96),
    ("cddl-1.1", r"common development and distribution licen[sc]e(?: cddl)? v(?:ersion)? ?1 1", 8, 0.97),
    ("cddl-1.0", r"common development and distribution licen[sc]e(?: cddl)? v(?:ersion)? ?1 0", 8, 0.97),
    ("cpal-1.0", r"common public attribution licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?", 12, 0.95),
    ("apsl-2.0", r"apple public source licen[sc]e(?: v(?:ersion)? ?2(?: 0)?)?", 12, 0.95),
    ("qpl-1.0", r"q public licen[sc]e(?: v(?:ersion)? ?1 0)?", 15, 0.93),
    ("nposl-3.0", r"non profit open software licen[sc]e(?: v?3 0)?", 10, 0.95),
    ("rpl-1.5", r"reciprocal public licen[sc]e(?: v?1 5)?", 15, 0.94),
    ("upl-1.0", r"universal permissive licen[sc]e(?: v(?:ersion)? ?1 0)?", 12, 0.96),
    ("ecl-2.0", r"educational community licen[sc]e(?: v(?:ersion)? ?2 0)?", 12, 0.95),
    ("efl-2.0", r"eiffel forum licen[sc]e(?: v(?:ersion)? ?2)?", 12, 0.95),
    ("fair", r"the fair licen[sc]e", 25, 0.85),
    ("frameworx-1.0", r"frameworx open licen[sc]e(?: 1 0)?", 12, 0.95),
    ("lpl-1.02", r"lucent public licen[sc]e(?: v(?:ersion)? ?1 02)?", 12, 0.95),
    ("motosoto", r"motosoto open source licen[sc]e", 12, 0.95),
    ("nasa-1.3", r"nasa open source agreement(?: 1 3)?", 12, 0.95),
    ("naumen", r"naumen public licen[sc]e", 12, 0.95),
    ("nokia", r"nokia open source licen[sc]e", 12, 0.95),
    ("oclc-2.0", r"oclc research public licen[sc]e(?: 2 0)?", 12, 0.95),
    ("realnetworks", r"realnetworks public source licen[sc]e(?: v1 0)?", 12, 0.95),
    ("ricoh", r"ricoh source code public licen[sc]e", 12, 0.95),
    ("sleepycat", r"sleepycat licen[sc]e", 15, 0.95),
    ("simple-2.0", r"simple public licen[sc]e(?: 2 0)?", 20, 0.92),
    ("vsl-1.0", r"vovida software licen[sc]e(?: v1 0)?", 12, 0.95),
    ("watcom-1.0", r"sybase open watcom public licen[sc]e(?: 1 0)?", 12, 0.95),
    ("xnet", r"x net licen[sc]e", 20, 0.92),
    ("zpl-2.1", r"zope public licen[sc]e(?: v(?:ersion)? ?2 1)?", 12, 0.95),
    ("zpl-2.0", r"zope public licen[sc]e v(?:ersion)? ?2 0", 8, 0.96),
    ("ipl-1.0", r"intel open source licen[sc]e", 12, 0.95),
    ("jabber", r"jabber open source licen[sc]e", 12, 0.95),
    ("cvw", r"mitre collaborative virtual workspace licen[sc]e", 12, 0.95),
    ("catosl-1.1", r"computer associates trusted open source licen[sc]e(?: 1 1)?", 12, 0.95),
    ("eudatagrid", r"eu datagrid software licen[sc]e", 12, 0.95),
    ("entessa", r"entessa public licen[sc]e", 12, 0.95),
    ("lppl-1.3c", r"latex project public licen[sc]e(?: v(?:ersion)? ?1 3c)?", 12, 0.96),
    ("osl-2.1", r"open software licen[sc]e v?(?:ersion )?2 1", 8, 0.96),
    ("afl-2.1", r"academic free licen[sc]e v(?:ersion)? ?2 1", 8, 0.96),
    ("oset-pl-2.1", r"oset foundation public licen[sc]e(?: v(?:ersion)? ?2 1)?", 12, 0.95),
    ("blueoak-1.0", r"blue oak model licen[sc]e(?: 1 0 0)?", 12, 0.96),
    ("mulan-2.0", r"mulan psl v2", 12, 0.95),
    ("mulan-2.0", r"mulan permissive software licen[sc]e(?: v(?:ersion)? ?2)?", 12, 0.95),
    ("polyform-nc", r"polyform noncommercial licen[sc]e(?: 1 0 0)?", 12, 0.96),
    ("polyform-sb", r"polyform small business licen[sc]e(?: 1 0 0)?", 12, 0.96),
    ("prosperity", r"prosperity public licen[sc]e(?: 3 0 0)?", 12, 0.95),
    ("parity", r"parity public licen[sc]e(?: 7 0 0)?", 12, 0.95),
    ("hippocratic", r"hippocratic licen[sc]e", 15, 0.95),
    ("eupl-1.1", r"european union public licen[sc]e v(?:ersion)? ?1 1", 8, 0.96),
    ("cecill-b", r"cecill b(?: licen[sc]e)?", 10, 0.93),
    ("cecill-c", r"cecill c(?: licen[sc]e)?", 10, 0.93),
    ("cern-ohl-s-2.0", r"cern open hardware licen[sc]e(?: version 2 strongly reciprocal)?", 12, 0.95),
    ("tapr-ohl", r"tapr open hardware licen[sc]e", 12, 0.95),
    ("solderpad", r"solderpad hardware licen[sc]e", 12, 0.95),
    ("gfdl-no-invariant", r"with no invariant sections no front cover texts and no back cover texts", 12, 0.95),
    ("ogl-uk-3.0", r"open government licen[sc]e(?: v(?:ersion)? ?3 0)?", 12, 0.95),
    ("cdla-permissive", r"community data licen[sc]e agreement permissive", 10, 0.96),
    ("cdla-sharing", r"community data licen[sc]e agreement sharing", 10, 0.96),
    ("openrail", r"(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?", 15, 0.92),
    ("openrail", r"responsible ai licen[sc]e", 20, 0.9),
    ("free-art-1.3", r"free art licen[sc]e(?: 1 3)?", 15, 0.94),
    ("oasis", r"oasis open ipr policy", 20, 0.85),
    ("json", r"the software shall be used for good not evil", 8, 0.97),
    ("ftl", r"freetype (?:project )?licen[sc]e", 15, 0.95),
    ("ijg", r"independent jpeg group s? ?(?:licen[sc]e|software)", 20, 0.9),
    ("imagemagick", r"imagemagick licen[sc]e", 15, 0.95),
    ("info-zip", r"info zip licen[sc]e", 15, 0.95),
    ("mirros", r"miros licen[sc]e", 15, 0.94),
    ("vim", r"vim licen[sc]e", 15, 0.93),
    ("tcl", r"tcl tk licen[sc]e", 15, 0.93),
    ("icu", r"icu licen[sc]e", 15, 0.93),
    ("net-snmp", r"net snmp licen[sc]e", 15, 0.93),
    ("bzip2", r"bzip2 licen[sc]e", 15, 0.93),
    ("sqlite-blessing", r"may you do good and not evil", 10, 0.96),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 12, 0.97),
    ("public-domain", r"this work is in the public domain", 30, 0.9),
    ("public-domain", r"no copyright protection", 60, 0.5),
    ("wtfpl", r"do what the [a-z]+ you want", 35, 0.85),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", 8, 0.98),
    ("cc-publicdomain-mark", r"creativecommons org publicdomain mark 1 0", 8, 0.97),
    ("cc0-1.0", r"waive(?:d|s)? all copyright and related or neighboring rights", 15, 0.93),
    ("cc-sampling", r"creative commons sampling plus(?: 1 0)?", 15, 0.93),
    ("proprietary", r"do not (?:copy or )?distribute without (?:prior |written |express )?permission", 40, 0.85),
    ("proprietary", r"may not be reproduced (?:[a-z0-9]+ ){0,12}without (?:the )?(?:prior |express )?(?:written )?permission", 40, 0.85),
    ("proprietary", r"trade secrets? of", 70, 0.5),
    ("proprietary", r"for internal use only", 60, 0.7),
    ("proprietary", r"commercial licen[sc]e agreement", 50, 0.75),
    ("proprietary", r"end user licen[sc]e agreement", 40, 0.85),
    ("proprietary", r"evaluation licen[sc]e", 60, 0.6),
    ("non-commercial", r"for non ?commercial use only", 40, 0.85),
    ("non-commercial", r"non ?commercial purposes only", 40, 0.85),
    ("shareware", r"this (?:software|program) is shareware", 40, 0.85),
    ("freeware", r"this (?:software|program) is freeware", 40, 0.85),
    ("no-warranty", r"this program is distributed in the hope that it will be useful but without any warranty", 80, 0.5),
    ("no-warranty", r"in no event shall the (?:authors?|copyright holders?)(?: or copyright holders?)? be liable", 80, 0.5),
]
#: Creative Commons terms, in words as they are spelt after splitting; the parts of their SPDX names agree.
CC_TERMS = {"by": "attribution", "by nc": "attribution noncommercial", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Names that SPDX tags carry after 'spdx license identifier'.
TAGS = ("gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "apache 2 0", "mit", "isc", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "epl 2 0", "unlicense", "cc0 1 0", "bsl 1 0", "zlib", "0bsd", "artistic 2 0", "postgresql")


def _named(words: str) -> str:
    """'by nc 4 0' -> 'by-nc-4.0': digits that follow digits are versions."""
    out = ""
    for w in words.split():
        out += w if not out else ("." if w.isdigit() and out[-1].isdigit() else "-") + w
    return out


def rules() -> list[Rule]:
    """All signatures: the hand-written ones, and the families of Creative Commons and SPDX tags."""
    found = [Rule(*r) for r in WRITTEN]
    for terms, spelt in CC_TERMS.items():
        for v in CC_VERSIONS:
            found.append(Rule(_named(f"cc {terms} {v}"), rf"cc {terms} {v}(?: international| unported)?", 10, 0.98))
            found.append(Rule(_named(f"cc {terms} {v}"), rf"creative commons {spelt} {v}(?: international| unported)?(?: licen[sc]e)?", 10, 0.98))
        # a version whose part after the point is left out, or none
        found.append(Rule(_named(f"cc {terms} 4.0").replace("-4.0", "-4"), rf"cc {terms} 4", 30, 0.93))
        found.append(Rule(_named(f"cc {terms}"), rf"cc {terms}", 40, 0.9))
        found.append(Rule(_named(f"cc {terms}"), rf"creative commons {spelt}(?: licen[sc]e)?", 40, 0.9))
    found += [Rule(_named(tag), rf"spdx licen[sc]e identifier {tag}", 5, 0.99) for tag in TAGS]
    return found


SPAN = "struct<s:int,e:int,p:int,label:string,conf:double>"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ ]+"))


#: Stands for a character that a pattern leaves open.
OPEN = "\0"


def spellings(pattern: str) -> list[str]:
    """All texts of a signature, with ``OPEN`` for what it leaves open and each repeat at its least number.

    Signatures use groups, alternatives, classes in brackets, and the repeats ``?``, ``+`` and ``{..}``; no escapes.
    """
    at = 0

    def atom() -> list[str]:
        nonlocal at
        if pattern.startswith("(?:", at):
            at += 3
            found = either()
            at += 1
            return found
        if pattern[at] == "[":
            end = pattern.index("]", at)
            inside, at = pattern[at + 1 : end], end + 1
            return list(inside) if len(inside) == 2 else [OPEN]
        at += 1
        return [pattern[at - 1]]

    def chain() -> list[str]:
        nonlocal at
        found = [""]
        while at < len(pattern) and pattern[at] not in "|)":
            one = atom()
            if pattern[at : at + 1] == "?":
                at += 1
                one = ["", *one]
            elif pattern[at : at + 1] == "+":
                at += 1
            elif pattern[at : at + 1] == "{":
                end = pattern.index("}", at)
                least, at = int(pattern[at + 1 : end].split(",")[0]), end + 1
                one = [x * least for x in one] if least else ["", *one]
            found = [a + b for a in found for b in one]
        return found

    def either() -> list[str]:
        nonlocal at
        found = chain()
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            found += chain()
        return found

    return either()


def keywords(pattern: str) -> list[list[str]]:
    """Words that a match must hold: one at least of each list.

    They are the words that all of a signature's spellings share, long ones first; where spellings
    share none, the longest word of each.
    """
    held = [{w for w in text.split() if OPEN not in w} for text in spellings(pattern)]
    if shared := set.intersection(*held):
        return [[w] for w in sorted(shared, key=lambda w: (-len(w), w))]
    return [sorted({max(words, key=lambda w: (len(w), w)) for words in held})]


def _detections(found: Column) -> Column:
    """All places of the rules' matches as intervals of characters."""

    def of(r: Column) -> Column:
        return F.zip_with(ends(r["m"], r["x"]), r["m"], lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), r["p"].alias("p"), r["label"].alias("label"), r["conf"].alias("conf")))

    return F.flatten(F.transform(found, of))


def _kept(every: Column) -> Column:
    """Detections without those that another holds: a longer one of the same or a stronger priority, or a stronger one of equal extent.

    In the order of start, then length downwards, then strength, what holds a detection stands before
    it.  So for each priority one running maximum of the ends, over detections no weaker, tells.
    """
    key = lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["p"].alias("p"), x["label"].alias("label"), x["conf"].alias("conf"))
    ordered = F.array_sort(F.array_distinct(F.transform(every, key)))
    marked = F.transform(ordered, lambda x: F.struct(x["s"].alias("s"), (-x["n"]).alias("e"), x["p"].alias("p"), x["label"].alias("label"), x["conf"].alias("conf"), F.lit(False).alias("held")))
    levels = F.array_distinct(F.transform(every, lambda x: x["p"]))

    def mark(acc: Column, p: Column) -> Column:
        reach = before(running(F.transform(acc, lambda a: F.when(a["p"] <= p, a["e"]).otherwise(-1)), lambda x, y: F.greatest(x, y), F.lit(-1)), F.lit(-1))
        return F.zip_with(acc, reach, lambda a, r: a.withField("held", a["held"] | ((a["p"] == p) & (r >= a["e"]))))

    done = F.filter(F.aggregate(levels, marked, mark), lambda a: ~a["held"])
    return F.transform(done, lambda a: a.dropFields("held"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and place counts, base and all labels, score, and the detections that remain."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), GAP, " ")), F.lit(" ")).alias("norm"))
    every = rules()
    gates = [keywords(r.pattern) for r in every]
    known = sorted({w for gate in gates for any_of in gate for w in any_of})
    out = out.withColumn("low", F.lower("norm"))
    words = F.split(F.trim("low"), " ", -1)
    out = out.withColumns({"n_words": F.when(F.length("norm") > 2, F.size(words)).otherwise(0).cast("long"), "held": F.array_intersect(words, F.array(*[F.lit(w) for w in known]))})

    phrase = "(?i)(?<= )(?:" + "|".join(PHRASES) + ")(?= )"
    none = F.array().cast("array<string>")
    likely = reduce(lambda a, b: a | b, [F.col("low").contains(p) for p in PHRASES])
    out = out.withColumn("m", F.when(likely, F.regexp_extract_all("norm", F.lit(phrase), F.lit(0))).otherwise(none))
    out = out.withColumn("pieces", F.when(F.size("m") > 0, F.split("norm", phrase, -1)))
    label_of = F.map_from_arrays(F.array(*[F.lit(k) for k in PHRASES]), F.array(*[F.lit(v) for v in PHRASES.values()]))

    # One SQL text for all signatures: it is parsed at once, where building it from columns takes seconds.
    # It stands inside a lambda, so it is interpreted: compiled, its hundreds of branches take a gigabyte of the compiler's memory.
    def tried(r: Rule, gate: list[list[str]]) -> str:
        # Characters that regex classes tell apart only by ASCII case are matched without it.
        pattern = f"'(?i)(?<= )(?:{r.pattern})(?= )'"
        may = " AND ".join("(" + " OR ".join(f"array_contains(t.held, '{w}')" for w in any_of) + ")" for any_of in gate)
        return f"IF({may}, named_struct('m', regexp_extract_all(t.norm, {pattern}, 0), 'x', split(t.norm, {pattern}, -1), 'p', {r.priority}, 'label', '{r.label}', 'conf', {r.confidence}D), NULL)"

    matched = F.expr("transform(array(struct(held, norm)), t -> filter(array(" + ", ".join(tried(r, gate) for r, gate in zip(every, gates, strict=True)) + "), h -> size(h.m) > 0))[0]")
    out = out.withColumn("matched", F.when(F.size("held") > 0, matched))
    nothing = F.array().cast(f"array<{SPAN}>")
    out = out.withColumn("found", F.when(F.size("matched") > 0, _detections(F.col("matched"))).otherwise(nothing))
    out = out.withColumn("kept", F.when(F.size("found") > 1, _kept(F.col("found"))).otherwise(F.col("found")))
    base = F.array_sort(F.array_distinct(F.transform("m", lambda m: F.element_at(label_of, F.lower(m)))))
    out = out.withColumn("base", F.when(F.size("m") > 0, base).otherwise(none))
    # the greatest confidence of each label, in the labels' order; structs are ordered by their fields
    best = F.array_sort(F.array_distinct(F.transform("kept", lambda x: F.struct(x["label"].alias("label"), (-x["conf"]).alias("less")))))
    confs = F.transform(F.filter(let(best, lambda b: F.zip_with(b, before(F.transform(b, lambda x: x["label"]), F.lit("")), lambda x, y: F.struct(x["less"].alias("less"), (x["label"] != y).alias("new")))), lambda x: x["new"]), lambda x: -x["less"])
    confs = F.concat(confs, F.transform(F.array_except("base", F.transform("kept", lambda x: x["label"])), lambda _: F.lit(0.9)))
    score = F.lit(1.0) - F.aggregate(confs, F.lit(1.0), lambda acc, c: acc * (F.lit(1.0) - c))
    some = F.size("m") > 0
    return out.select(
        "doc_id",
        "n_words",
        F.size("m").cast("long").alias("n_base"),
        F.when(some, _words(F.col("pieces")[0])).cast("long").alias("first_word"),
        F.when(some, F.col("n_words") - _words(F.element_at("pieces", -1)) - _words(F.element_at("m", -1))).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("kept", lambda x: x["label"]))), ",").alias("labels"),
        F.when((F.size("kept") > 0) | some, F.round(score, 6)).otherwise(0.0).alias("score"),
        F.col("kept").alias("detections"),
    )


def op7_query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("detections")
