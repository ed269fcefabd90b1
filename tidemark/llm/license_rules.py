"""Signature rules of the license scan: label | priority | keyword | pattern, one a line, in order.

Patterns are regular expressions over words: lower case, punctuation gone, one blank between words (so version 2.0 is
``2 0``), in the syntax that Java, RE2 and Python share. A pattern begins and ends with whole words. The keyword is a
piece of text without which the pattern cannot match. Priority 3: notices and texts; 2: a name with a version or form;
1: a bare name or a general sign.
"""

RULES = r"""
mit|1|mit|mit license
apache|1|apache|apache license
gpl|1|general public|general public license
mit|2|mit|(the )?mit license mit
mit|2|mit|(licensed|released|distributed|available) under (the )?(terms of )?(the )?mit license
mit|2|spdx|spdx license identifier mit
mit|2|expat|expat( mit)? license
mit|3|permission is|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|3|substantial portions|the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0|2|mit|mit( no attribution| 0) license
mit-modern|3|permission is|permission is hereby granted without written agreement and without license or royalty fees to use copy modify
mit-cmu|2|cmu|(mit cmu|cmu) license
mit-advertising|3|advertising|mit license with advertising clause
x11|2|x11|x11( license| style license| distribute modifications)
isc|2|isc|isc license
isc|2|spdx|spdx license identifier isc
isc|3|hereby granted|permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
0bsd|2|0bsd|0bsd( license)?
0bsd|3|hereby granted|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
apache-1.0|2|apache|apache( software)? license( version| v)? 1 0
apache-1.1|2|apache|apache( software)? license( version| v)? 1 1
apache-2.0|2|apache|apache( software)? license( version| v)? 2( 0)?
apache-2.0|2|apache|(licensed|released|distributed|available) under (the )?apache( license)?( version| v)? 2( 0)?
apache-2.0|2|apache|apache 2( 0)?( license)?
apache-2.0|2|apache|asl 2( 0)? apache
apache-2.0|2|spdx|spdx license identifier apache 2 0
apache-2.0|3|apache|licensed under the apache license version 2 0
apache-2.0|3|apache|licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0|3|distributed on an|software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0|2|apache|apache org licenses license 2 0
gpl-1.0|2|gpl|(gnu )?gpl( version| v)? ?1( 0)?( only| or later)?
gpl-1.0|2|general public|(gnu )?general public license( version| v)? 1( 0)?
gpl-2.0|2|gpl|(gnu )?gpl( version)? 2( 0)?
gpl-2.0|2|gplv2|(gnu )?gplv2
gpl-2.0-or-later|2|gpl|(gnu )?gpl( version)? 2( 0)? or( any)? later
gpl-2.0-only|2|gpl|(gnu )?gpl( version)? 2( 0)? only
gpl-2.0|2|general public|(gnu )?general public license( version| v)? 2( 0)?
gpl-2.0-or-later|3|general public|general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-only|3|general public|general public license version 2 as published by the free software foundation
gpl-3.0|2|gpl|(gnu )?gpl( version)? 3( 0)?
gpl-3.0|2|gplv3|(gnu )?gplv3
gpl-3.0-or-later|2|gpl|(gnu )?gpl( version)? 3( 0)? or( any)? later
gpl-3.0-only|2|gpl|(gnu )?gpl( version)? 3( 0)? only
gpl-3.0|2|general public|(gnu )?general public license( version| v)? 3( 0)?
gpl-3.0|3|general public|licensed under the gnu general public license version 3
gpl-3.0-or-later|3|general public|general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl|2|general public|gnu general public license
gpl|3|general public|this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-classpath|2|classpath|classpath exception( 2 0)?
gpl-gcc-exception|2|runtime library|gcc runtime library exception
gpl-font-exception|2|font exception|gpl font exception
gpl-bison-exception|2|bison|bison exception( 2 2)?
gpl-autoconf-exception|2|autoconf|autoconf exception( 2 0| 3 0)?
gpl-linux-note|2|syscall|linux syscall note
lgpl|2|lesser|(gnu )?lesser general public license
lgpl|2|library general|(gnu )?library general public license
lgpl|1|lgpl|(gnu )?lgpl
lgpl-2.0|2|library general|(gnu )?library general public license( version| v)? 2( 0)?
lgpl-2.0|2|lgpl|(gnu )?lgpl( version)? 2 0
lgpl-2.1|2|lesser|(gnu )?lesser general public license( version| v)? 2 1
lgpl-2.1|2|lgpl|(gnu )?lgpl( version)? 2 1
lgpl-2.1|2|lgplv2|(gnu )?lgplv2( 1)?
lgpl-2.1-or-later|2|lgpl|(gnu )?lgpl( version)? 2 1 or( any)? later
lgpl-2.1-or-later|3|lesser|lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0|2|lesser|(gnu )?lesser general public license( version| v)? 3( 0)?
lgpl-3.0|2|lgpl|(gnu )?lgpl( version)? 3( 0)?
lgpl-3.0|2|lgplv3|(gnu )?lgplv3
agpl|2|affero|(gnu )?affero general public license
agpl|1|agpl|(gnu )?agpl
agpl-1.0|2|affero|affero general public license( version| v)? 1( 0)?
agpl-3.0|2|affero|(gnu )?affero general public license( version| v)? 3( 0)?
agpl-3.0|2|agpl|(gnu )?agpl( version)? 3( 0)?
agpl-3.0|2|agplv3|(gnu )?agplv3
agpl-3.0-or-later|3|affero|affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gfdl|1|free documentation|(gnu )?free documentation license
gfdl-1.1|2|free documentation|(gnu )?free documentation license( version| v)? 1 1
gfdl-1.2|2|free documentation|(gnu )?free documentation license( version| v)? 1 2
gfdl-1.3|2|free documentation|(gnu )?free documentation license( version| v)? 1 3
gfdl|1|gfdl|(gnu )?gfdl
gfdl-invariants|3|invariant sections|with (no|the) invariant sections
bsd|1|bsd|bsd( style)? license
bsd-1-clause|2|bsd|(bsd 1 clause|1 clause bsd)( license)?
bsd-2-clause|2|bsd|(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)( license)?
bsd-2-clause-patent|2|bsd|bsd 2 clause (plus )?patent( license)?
bsd-2-clause-views|2|bsd|bsd 2 clause (freebsd|views)( license)?
bsd-3-clause|2|bsd|(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)( license)?
bsd-3-clause-clear|2|bsd|(bsd 3 clause clear|clear bsd)( license)?
bsd-3-clause-lbnl|2|bsd|(bsd 3 clause lbnl|lawrence berkeley national labs bsd)( variant)?( license)?
bsd-3-clause-nuclear|2|bsd|bsd 3 clause no nuclear( license| warranty)?
bsd-4-clause|2|bsd|(bsd 4 clause|4 clause bsd|original bsd|old bsd)( license)?
bsd-source-code|2|bsd|bsd source code( attribution)?
bsd-protection|2|bsd|bsd protection license
bsd|3|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause|3|endorse|neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause|3|advertising|all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-disclaimer|3|as is|this software is provided by .{1,80} as is and any express or implied warranties
cc|1|creative commons|creative commons( license)?
cc0-1.0|2|cc0|cc0( 1 0)?( universal)?( license)?
cc0-1.0|2|creative commons|creative commons (cc0|zero)( 1 0)?( universal)?
cc0-1.0|3|waived all|has waived all copyright and related or neighboring rights
cc-pddc|2|pddc|cc pddc
cc-pddc|2|public domain|creative commons public domain dedication
cc-by|1|cc by|cc by
cc-by-1.0|2|cc by|cc by 1 0
cc-by-2.0|2|cc by|cc by 2 0
cc-by-2.5|2|cc by|cc by 2 5
cc-by-3.0|2|cc by|cc by 3 0
cc-by-4.0|2|cc by|cc by 4 0
cc-by-4.0|2|creative commons|creative commons attribution( license)? 4 0( international)?( license)?
cc-by-3.0|2|creative commons|creative commons attribution( license)? 3 0( unported)?( license)?
cc-by-2.5|2|creative commons|creative commons attribution 2 5( generic)?
cc-by-2.0|2|creative commons|creative commons attribution 2 0( generic)?
cc-by|1|creative commons|creative commons attribution( license)?
cc-by-sa|1|cc by|cc by sa
cc-by-sa-1.0|2|cc by|cc by sa 1 0
cc-by-sa-2.0|2|cc by|cc by sa 2 0
cc-by-sa-2.5|2|cc by|cc by sa 2 5
cc-by-sa-3.0|2|cc by|cc by sa 3 0
cc-by-sa-4.0|2|cc by|cc by sa 4 0
cc-by-sa-4.0|2|creative commons|creative commons attribution share ?alike 4 0( international)?
cc-by-sa-3.0|2|creative commons|creative commons attribution share ?alike 3 0( unported)?
cc-by-sa|1|creative commons|creative commons attribution share ?alike
cc-by-nc|1|cc by|cc by nc
cc-by-nc-1.0|2|cc by|cc by nc 1 0
cc-by-nc-2.0|2|cc by|cc by nc 2 0
cc-by-nc-2.5|2|cc by|cc by nc 2 5
cc-by-nc-3.0|2|cc by|cc by nc 3 0
cc-by-nc-4.0|2|cc by|cc by nc 4 0
cc-by-nc-4.0|3|cc by|licensed under cc by nc 4 0
cc-by-nc-4.0|2|creative commons|creative commons attribution non ?commercial 4 0( international)?
cc-by-nc-3.0|2|creative commons|creative commons attribution non ?commercial 3 0( unported)?
cc-by-nc|1|creative commons|creative commons attribution non ?commercial
cc-by-nd|1|cc by|cc by nd
cc-by-nd-2.0|2|cc by|cc by nd 2 0
cc-by-nd-3.0|2|cc by|cc by nd 3 0
cc-by-nd-4.0|2|cc by|cc by nd 4 0
cc-by-nd|1|creative commons|creative commons attribution no ?deriv(atives|ative works|s)
cc-by-nc-sa|1|cc by|cc by nc sa
cc-by-nc-sa-2.0|2|cc by|cc by nc sa 2 0
cc-by-nc-sa-3.0|2|cc by|cc by nc sa 3 0
cc-by-nc-sa-4.0|2|cc by|cc by nc sa 4 0
cc-by-nc-sa|1|creative commons|creative commons attribution non ?commercial share ?alike
cc-by-nc-nd|1|cc by|cc by nc nd
cc-by-nc-nd-2.0|2|cc by|cc by nc nd 2 0
cc-by-nc-nd-3.0|2|cc by|cc by nc nd 3 0
cc-by-nc-nd-4.0|2|cc by|cc by nc nd 4 0
cc-by-nc-nd|1|creative commons|creative commons attribution non ?commercial no ?deriv(atives|ative works|s)
public-domain|1|public domain|(released|placed|dedicated) (in|into|to) the public domain
public-domain|1|public domain|this (work|software|file|code|document) is( in the)? public domain
unlicense|2|unlicense|(the )?unlicense
unlicense|3|unencumbered|this is free and unencumbered software released into the public domain
wtfpl|2|wtfpl|wtfpl( version)?( 1| 2)?
wtfpl|3|you want to|do what the f.{1,3} you want to( public license)?
mpl|1|mozilla|mozilla public license
mpl-1.0|2|mozilla|mozilla public license( version| v)? 1 0
mpl-1.1|2|mozilla|mozilla public license( version| v)? 1 1
mpl-2.0|2|mozilla|mozilla public license( version| v)? 2( 0)?
mpl-1.1|2|mpl|mpl( version)? 1 1
mpl-2.0|2|mpl|mpl( version)? 2( 0)?
mpl-2.0|3|mozilla|this source code form is subject to the terms of the mozilla public license v(ersion)? 2 0
mpl-2.0-no-copyleft|3|incompatible|incompatible with secondary licenses
npl-1.0|2|netscape|netscape public license( version)?( 1 0)?
npl-1.1|2|netscape|netscape public license( version)? 1 1
epl-1.0|2|eclipse|eclipse public license( version| v)? 1( 0)?
epl-2.0|2|eclipse|eclipse public license( version| v)? 2( 0)?
epl|1|eclipse|eclipse public license
epl-1.0|2|epl|epl( version)? 1 0
epl-2.0|2|epl|epl( version)? 2 0
edl-1.0|2|eclipse|eclipse distribution license( version| v)?( 1 0)?
cpl-1.0|2|common public|common public license( version)?( 1 0)?
cpal-1.0|2|common public|common public attribution license( version)?( 1 0)?
ipl-1.0|2|ibm|ibm public license( version)?( 1 0)?
cddl-1.0|2|common development|common development and distribution license( version| v)?( 1 0)?
cddl-1.1|2|common development|common development and distribution license( version| v)? 1 1
cddl|1|cddl|cddl( 1 0| 1 1)?
eupl-1.0|2|eupl|eupl( version| v)? 1 0
eupl-1.1|2|eupl|eupl( version| v)? 1 1
eupl-1.2|2|eupl|eupl( version| v)? 1 2
eupl|1|european union public|european union public licen[cs]e
cecill-1.0|2|cecill|cecill( version)? 1 0
cecill-2.0|2|cecill|cecill( version)? 2 0
cecill-2.1|2|cecill|cecill( version)? 2 1
cecill-b|2|cecill|cecill b( license)?
cecill-c|2|cecill|cecill c( license)?
artistic|1|artistic|artistic license
artistic-1.0|2|artistic|artistic license( version)? 1 0
artistic-1.0-perl|2|artistic|artistic license( 1 0)? perl
artistic-2.0|2|artistic|artistic license( version)? 2( 0)?
perl|2|perl|same terms as perl( itself)?
psf-2.0|2|python software|python software foundation license( version)?( 2)?
python-2.0|2|python|python license( version)? 2 0
python-cnri|2|cnri|cnri python( open source)? license
php-3.0|2|php|php license( version)? 3 0
php-3.01|2|php|php license( version)? 3 01
ruby|2|ruby|ruby license
zlib|2|zlib|zlib( libpng)? license
zlib|3|altered source|altered source versions must be plainly marked as such
libpng|2|libpng|libpng license( version 2)?
libpng|2|png reference|png reference library license( version 2)?
libtiff|2|libtiff|libtiff license
ijg|2|jpeg group|independent jpeg group( license)?
bsl-1.0|2|boost|boost software license( version)?( 1 0)?
bsl-1.0|3|boost|distributed under the boost software license version 1 0
busl-1.1|2|business source|business source license( version)?( 1 1)?
elastic-2.0|2|elastic|elastic license( version)?( 2 0)?
sspl-1.0|2|server side|server side public license( version| v)?( 1)?
commons-clause|2|commons clause|commons clause( license)?( condition)?
polyform|2|polyform|polyform (noncommercial|strict|shield|perimeter|small business|internal use)( license)?( 1 0 0)?
parity-7.0|2|parity public|parity public license( 7 0)?
prosperity-3.0|2|prosperity public|prosperity public license( 3 0)?
blueoak-1.0|2|blue oak|blue oak model license( version)?( 1 0 0)?
ms-pl|2|microsoft|microsoft public license( ms pl)?
ms-rl|2|microsoft|microsoft reciprocal license( ms rl)?
ms-lpl|2|microsoft|microsoft limited public license
apsl-1.0|2|apple|apple public source license( version)? 1 0
apsl-2.0|2|apple|apple public source license( version)?( 2 0)?
apple-mit|2|apple|apple mit license
intel|2|intel|intel open source license
nokia|2|nokia|nokia open source license
motosoto|2|motosoto|motosoto license
sleepycat|2|sleepycat|sleepycat license
postgresql|2|postgresql|postgresql licen[cs]e
openldap-2.8|2|openldap|openldap public license( version)?( 2 8)?
openssl|2|openssl|openssl license
ssleay|2|ssleay|(original )?ssleay license
curl|2|curl|curl license
w3c|2|w3c|w3c (software|document|license)( notice)?( and license)?
ofl-1.0|2|open font|(sil )?open font license( version)? 1 0
ofl-1.1|2|open font|(sil )?open font license( version)?( 1 1)?
ofl-1.1|2|ofl|(sil )?ofl( version)? 1 1
ubuntu-font|2|ubuntu font|ubuntu font licen[cs]e( version)?( 1 0)?
bitstream-vera|2|bitstream|bitstream vera( fonts?)? (license|copyright)
lppl-1.0|2|latex project|latex project public license( version)? 1 0
lppl-1.3c|2|latex project|latex project public license( version)?( 1 3c?)?
afl-1.1|2|academic free|academic free license( version| v)? 1 1
afl-2.1|2|academic free|academic free license( version| v)? 2 1
afl-3.0|2|academic free|academic free license( version| v)?( 3 0)?
osl-1.0|2|open software|open software license( version| v)? 1 0
osl-2.1|2|open software|open software license( version| v)? 2 1
osl-3.0|2|open software|open software license( version| v)?( 3 0)?
ecl-1.0|2|educational community|educational community license( version)? 1 0
ecl-2.0|2|educational community|educational community license( version)?( 2 0)?
ncsa|2|ncsa|(university of illinois )?ncsa open source license
upl-1.0|2|universal permissive|universal permissive license( version| v)?( 1 0)?
qpl-1.0|2|q public|q public license( version)?( 1 0)?
rpl-1.1|2|reciprocal public|reciprocal public license( version)? 1 1
rpl-1.5|2|reciprocal public|reciprocal public license( version)?( 1 5)?
spl-1.0|2|sun public|sun public license( version| v)?( 1 0)?
sissl|2|sun industry|sun industry standards source license
nposl-3.0|2|non profit open|non profit open software license( 3 0)?
watcom-1.0|2|watcom|sybase open watcom public license( 1 0)?
zpl-2.0|2|zope|zope public license( version)? 2 0
zpl-2.1|2|zope|zope public license( version)?( 2 1)?
vim|2|vim|vim license
tcl|2|tcl|tcl tk license
beerware|2|beer|beer ?ware license
beerware|3|buy me a beer|you can buy me a beer in return
json|3|shall be used for good|the software shall be used for good not evil
ncbi|2|ncbi|ncbi public domain notice
nist|2|nist|nist (software|public domain)( license| notice)?
nasa-1.3|2|nasa|nasa open source agreement( version)?( 1 3)?
odbl-1.0|2|database license|open (data commons )?(open )?database license( version| v)?( 1 0)?
odc-by-1.0|2|open data commons|open data commons attribution license( version| v)?( 1 0)?
pddl-1.0|2|public domain dedication|public domain dedication and license( version| v)?( 1 0)?
cdla-permissive|2|community data|community data license agreement permissive( 1 0| 2 0)?
cdla-sharing|2|community data|community data license agreement sharing( 1 0)?
ogl-uk|2|open government|open government licen[cs]e( version| v)?( 1 0| 2 0| 3 0)?
etalab-2.0|2|licence ouverte|licence ouverte( open licence)?( version)?( 2 0)?
dl-de-by|2|datenlizenz|datenlizenz deutschland namensnennung( 2 0)?
free-art-1.3|2|free art|free art license( 1 3)?
licence-art-libre|2|art libre|licence art libre( 1 3)?
openrail|2|rail|(creativeml )?open ?rail( m)?( license)?
llama|2|llama|llama( 2| 3)? community license( agreement)?
hippocratic|2|hippocratic|hippocratic license( version)?( 2 1| 3 0)?
anti-996|2|996|anti 996 license( version)?( 1 0)?
mulan-psl-2.0|2|mulan|mulan (psl|permissive software license)( v2| v1| version 2)?
unicode|2|unicode|unicode (license agreement|license v3|data files and software)
icu|2|icu|icu license
bzip2|2|bzip2|bzip2( and libbzip2)? license
info-zip|2|info zip|info zip license
freetype|2|freetype|freetype( project)? license
imagemagick|2|imagemagick|imagemagick license
jasper-2.0|2|jasper|jasper( 2 0)? license
ntp|2|ntp|ntp license
oldap|2|oldap|oldap( 2 0| 2 7| 2 8)?
proprietary|2|proprietary|proprietary and confidential
proprietary|2|unauthorized|unauthorized (copying|use|distribution|reproduction) of this (file|software|document|material)
all-rights-reserved|1|rights reserved|all rights reserved
copyright-notice|1|copyright|copyright c? ?(19|20)[0-9][0-9]
no-warranty|1|warranty|without( even the implied)? warranty( of any kind)?
license-reference|1|licen|see (the )?licen[cs]e( file| txt)? for (details|more|the full)
license-reference|1|copying|see (the )?copying( file| txt)? for (details|more|the full)
spdx|1|spdx|spdx license identifier [a-z0-9]+
"""


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) of every rule, in order."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split("|", 3)
        out.append((label, int(priority), keyword, pattern.rstrip("|")))
    return out
