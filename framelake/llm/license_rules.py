"""Hand-written signature rules of licenses.

A block starts with its label; each line below it is `priority regex`. Regexes see the text in lower case with all
runs of characters that are not letters, digits or one of `.:/-+` as one space. Priorities: 3 a whole grant or a tag, 2 a
full name, 1 a short mention. A rule is only tried where the longest literal that its regex can't do without stands in the
text of this form; it is read from the regex.
"""

from __future__ import annotations

import re
from re import _parser
from typing import NamedTuple

TABLE = r"""
gpl
3 licensed under (the )?(terms of )?(the )?gnu general public license
3 free software: you can redistribute it and/or modify it under the terms of the gnu general public license
3 spdx-license-identifier: gpl-[123]\.0(-only|-or-later|\+)?
3 gnu.org/licenses/(old-licenses/)?gpl(-[123]\.0)?(\.html|\.txt|\.en\.html)?
2 gnu general public license(,? version [123](\.0)?)?( or (any )?later)?
2 gnu gpl ?v?[123]?
1 gpl ?-?v[123](\+|\.0)?
1 gpl-[123]\.0
lgpl
3 licensed under (the )?(terms of )?(the )?gnu (lesser|library) general public license
3 spdx-license-identifier: lgpl-(2|2\.1|3)(\.0)?(-only|-or-later|\+)?
3 gnu.org/licenses/(old-licenses/)?lgpl(-[23]\.[01])?(\.html|\.txt)?
2 gnu (lesser|library) general public license( version (2|2\.1|3))?
1 lgpl ?-?v?(2\.1|2|3)(\+|\.0)?
agpl
3 licensed under (the )?(terms of )?(the )?gnu affero general public license
3 spdx-license-identifier: agpl-3\.0(-only|-or-later)?
3 gnu.org/licenses/agpl(-3\.0)?(\.html|\.txt)?
2 gnu affero general public license( version 3)?
1 agpl ?-?v?3(\.0)?
gfdl
3 permission is granted to copy distribute and/or modify this document under the terms of the gnu free documentation license
3 spdx-license-identifier: gfdl-1\.[123](-only|-or-later)?
3 gnu.org/licenses/(old-licenses/)?fdl(-1\.[123])?(\.html|\.txt)?
2 gnu free documentation license( version 1\.[123])?
1 gfdl ?-?v?1\.[123]
apache
3 licensed under the apache license,? version 2\.0
3 released under (the )?apache license
3 spdx-license-identifier: apache-(1\.[01]|2\.0)
3 apache.org/licenses/license-(1\.[01]|2\.0)(\.txt|\.html)?
2 apache (software )?license( version)? ?v?(1\.[01]|2(\.0)?)
2 apache license
1 apache-2\.0
1 asl ?2\.0
mit
3 (released|licensed|distributed|available) under (the )?(terms of )?(the )?mit license
3 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
3 spdx-license-identifier: mit(-0|-cmu|-feh)?
3 opensource.org/licenses/mit(-license)?(\.php|\.html)?
2 the mit license( mit)?
2 mit license
1 mit-licensed
1 license: mit
isc
3 permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted
3 spdx-license-identifier: isc
3 opensource.org/licenses/isc(-license)?(\.php|\.txt)?
2 (the )?isc license
1 license: isc
bsd-2-clause
3 spdx-license-identifier: bsd-2-clause(-patent|-views)?
3 opensource.org/licenses/bsd-2-clause
2 (simplified|freebsd|2-clause|two-clause|bsd 2-clause) bsd license
2 bsd 2-clause( license)?
1 bsd-2-clause
bsd-3-clause
3 spdx-license-identifier: bsd-3-clause(-clear|-lbnl|-attribution)?
3 opensource.org/licenses/bsd-3-clause
3 neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
2 (modified|new|revised|3-clause|three-clause) bsd license
2 bsd 3-clause( license)?
1 bsd-3-clause
bsd-4-clause
3 spdx-license-identifier: bsd-4-clause(-uc)?
3 all advertising materials mentioning features or use of this software must display the following acknowledgement
2 (original|4-clause|four-clause) bsd license
1 bsd-4-clause
bsd
3 redistribution and use in source and binary forms with or without modification are permitted
3 licensed under (the )?(terms of )?(the )?bsd license
3 spdx-license-identifier: (0bsd|bsd-1-clause)
2 bsd(-style)? license
1 license: bsd
mpl
3 this source code form is subject to the terms of the mozilla public license v\. ?2\.0
3 spdx-license-identifier: mpl-(1\.[01]|2\.0)(-no-copyleft-exception)?
3 mozilla.org/mpl/(2\.0|1\.[01])?/?
2 mozilla public license( version)? ?v?(1\.[01]|2\.0)?
1 mpl ?-?v?(1\.[01]|2\.0)
epl
3 this program and the accompanying materials are made available under the terms of the eclipse public license
3 spdx-license-identifier: epl-[12]\.0
3 eclipse.org/legal/epl-(v10|2\.0)(\.html)?
2 eclipse public license( ?-? ?v?(ersion )?[12]\.0)?
1 epl ?-?v?[12]\.0
edl
3 eclipse.org/org/documents/edl-v10(\.php|\.html)?
2 eclipse distribution license( v?(ersion )?1\.0)?
cddl
3 the contents of this file are subject to the terms of the common development and distribution license
3 spdx-license-identifier: cddl-1\.[01]
2 common development and distribution license( version)? ?v?(1\.[01])?
1 cddl ?-?v?1\.[01]
cpl
3 spdx-license-identifier: cpl-1\.0
2 common public license( version)? ?v?(1\.0)?
1 cpl-1\.0
cpal
3 spdx-license-identifier: cpal-1\.0
2 common public attribution license( version)? ?(1\.0)?
ipl
3 spdx-license-identifier: ipl-1\.0
2 ibm public license( version)? ?(1\.0)?
eupl
3 licensed under the eupl
3 spdx-license-identifier: eupl-1\.[012]
3 joinup.ec.europa.eu/(software/page|collection)/eupl
2 european union public licen[cs]e( v\.? ?1\.[012])?
1 eupl ?-?v?1\.[012]
cecill
3 spdx-license-identifier: cecill-(1\.[01]|2\.[01]|b|c)
3 cecill.info/licences
2 cecill(-[bc])? (free software )?licen[cs]e
1 cecill-(b|c|2\.[01])
osl
3 licensed under the open software license version [123]\.[01]
3 spdx-license-identifier: osl-[123]\.[01]
2 open software license( version)? ?v?([123]\.[01])?
afl
3 spdx-license-identifier: afl-(1\.[12]|2\.[01]|3\.0)
2 academic free license( version)? ?v?(1\.[12]|2\.[01]|3\.0)?
artistic
3 under the same terms as perl itself
3 spdx-license-identifier: artistic-(1\.0(-perl|-cl8)?|2\.0)
3 opensource.org/licenses/artistic-license(-2\.0|-1\.0)?
2 (the )?artistic license( version)? ?v?([12]\.0)?
unlicense
3 this is free and unencumbered software released into the public domain
3 spdx-license-identifier: unlicense
3 unlicense.org
2 the unlicense
1 license: unlicense
public-domain
3 (has been|is hereby|was) (placed|released|dedicated) (in|into|to) the public domain
2 public domain dedication
2 dedicated to the public domain
1 in the public domain
wtfpl
3 do what the fuck you want to public license
3 spdx-license-identifier: wtfpl
3 wtfpl.net
1 wtfpl
zlib
3 this software is provided as-is without any express or implied warranty
3 altered source versions must be plainly marked as such
3 spdx-license-identifier: zlib(-acknowledgement)?
2 zlib(/libpng)? license
libpng
3 spdx-license-identifier: libpng(-2\.0)?
2 (libpng|png reference library) license
boost
3 distributed under the boost software license version 1\.0
3 spdx-license-identifier: bsl-1\.0
3 boost.org/license 1 0(\.txt)?
2 boost software license( ?-? ?version 1\.0)?
1 bsl-1\.0
ncsa
3 spdx-license-identifier: ncsa
2 university of illinois/?(ncsa)? open source license
2 ncsa open source license
openssl
3 this product includes software developed by the openssl project
3 spdx-license-identifier: openssl
2 openssl( and ssleay)? licen[cs]e
php
3 php.net/license/3 0[01]?(\.txt)?
3 spdx-license-identifier: php-3\.(0|01)
2 php license( version)? ?v?(3\.(0|01))?
python
3 spdx-license-identifier: (psf|python)-2\.0(\.1)?
2 python software foundation license( version 2)?
1 psf license
ruby
3 spdx-license-identifier: ruby
2 (the )?ruby license
postgresql
3 spdx-license-identifier: postgresql
2 (the )?postgresql licen[cs]e
sleepycat
3 spdx-license-identifier: sleepycat
2 sleepycat license
vim
3 spdx-license-identifier: vim
2 vim license
tcl
3 spdx-license-identifier: tcl
2 tcl/tk license
x11
3 spdx-license-identifier: x11
2 (x11|x consortium) license
2 xfree86 license( 1\.1)?
w3c
3 w3.org/consortium/legal/(2015/)?copyright-software(-and-document)?
3 spdx-license-identifier: w3c(-19980720|-20150513)?
2 w3c software (notice and|and document)? ?license
unicode
3 unicode.org/copyright(\.html)?
3 spdx-license-identifier: unicode-(3\.0|dfs-201[56]|tou)
2 unicode (inc\. )?license agreement
ofl
3 this font software is licensed under the sil open font license,? version 1\.1
3 spdx-license-identifier: ofl-1\.[01]
3 scripts.sil.org/ofl
2 sil open font license( version 1\.1)?
1 ofl-1\.1
fontlicense
3 spdx-license-identifier: (bitstream-vera|ubuntu-font-1\.0)
2 bitstream vera (fonts )?(license|copyright)
2 ubuntu font licen[cs]e( version 1\.0)?
cc-by
3 (licensed|released|available) under (a |the )?cc[ -]by[ -][1234]\.0
3 creativecommons.org/licenses/by/[1234]\.[05]
3 creative commons attribution [1234]\.0 (international|generic|unported)
3 spdx-license-identifier: cc-by-[1234]\.[05]
2 creative commons attribution license
2 cc[ -]by( [1234]\.0)?
cc-by-sa
3 creativecommons.org/licenses/by-sa/[1234]\.[05]
3 creative commons attribution[ -]share ?-?alike [1234]\.[05] (international|generic|unported)
3 spdx-license-identifier: cc-by-sa-[1234]\.[05]
2 creative commons attribution[ -]share ?-?alike( license)?
2 cc[ -]by[ -]sa([ -][1234]\.[05])?
cc-by-nc
3 creativecommons.org/licenses/by-nc/[1234]\.[05]
3 spdx-license-identifier: cc-by-nc-[1234]\.[05]
2 creative commons attribution[ -]non ?-?commercial( license| [1234]\.[05])?
2 cc[ -]by[ -]nc([ -][1234]\.[05])?
cc-by-nc-sa
3 creativecommons.org/licenses/by-nc-sa/[1234]\.[05]
3 spdx-license-identifier: cc-by-nc-sa-[1234]\.[05]
2 creative commons attribution[ -]non ?-?commercial[ -]share ?-?alike
2 cc[ -]by[ -]nc[ -]sa([ -][1234]\.[05])?
cc-by-nd
3 creativecommons.org/licenses/by-nd/[1234]\.[05]
3 spdx-license-identifier: cc-by-nd-[1234]\.[05]
2 creative commons attribution[ -]no ?-?deriv(ative)?s
2 cc[ -]by[ -]nd([ -][1234]\.[05])?
cc-by-nc-nd
3 creativecommons.org/licenses/by-nc-nd/[1234]\.[05]
3 spdx-license-identifier: cc-by-nc-nd-[1234]\.[05]
2 creative commons attribution[ -]non ?-?commercial[ -]no ?-?deriv(ative)?s
2 cc[ -]by[ -]nc[ -]nd([ -][1234]\.[05])?
cc0
3 creativecommons.org/publicdomain/zero/1\.0
3 spdx-license-identifier: cc0-1\.0
2 creative commons (cc0|zero)( 1\.0)?( universal)?
2 cc0 1\.0( universal)?
1 license: cc0
odbl
3 opendatacommons.org/licenses/odbl(/1[.-]0)?
3 spdx-license-identifier: odbl-1\.0
2 open database license
odc-by
3 opendatacommons.org/licenses/by(/1[.-]0)?
3 spdx-license-identifier: odc-by-1\.0
2 open data commons attribution license
pddl
3 opendatacommons.org/licenses/pddl(/1[.-]0)?
3 spdx-license-identifier: pddl-1\.0
2 open data commons public domain dedication
ogl
3 nationalarchives.gov.uk/doc/open-government-licence
3 spdx-license-identifier: ogl-uk-[123]\.0
2 open government licen[cs]e( v?[123]\.0)?
ms-pl
3 spdx-license-identifier: ms-pl
2 microsoft public license( ms-pl)?
ms-rl
3 spdx-license-identifier: ms-rl
2 microsoft reciprocal license( ms-rl)?
sspl
3 spdx-license-identifier: sspl-1\.0
3 mongodb.com/licensing/server-side-public-license
2 server side public license( version)? ?v?1?
busl
3 spdx-license-identifier: busl-1\.1
2 business source license( 1\.1)?
elastic
3 elastic.co/licensing/elastic-license
3 spdx-license-identifier: elastic-2\.0
2 elastic license( 2\.0)?
commons-clause
3 the software is provided to you by the licensor under the license as defined below subject to the following condition
2 commons clause( license condition)?( v1\.0)?
mulan
3 spdx-license-identifier: mulanpsl-[12]\.0
3 license.coscl.org.cn/mulanpsl2?
2 mulan permissive software license
upl
3 spdx-license-identifier: upl-1\.0
2 universal permissive license( v?(ersion )?1\.0)?
bluoak
3 blueoakcouncil.org/license/1\.0\.0
3 spdx-license-identifier: blueoak-1\.0\.0
2 blue oak model license
openrail
3 licensed under (the )?(creativeml |bigscience |bigcode )?open ?rail(-m|\+\+-m)?
2 (creativeml|bigscience|bigcode) (open ?)?rail(-m|\+\+-m)?( license)?
1 openrail(-m|\+\+)?
proprietary
2 all rights reserved
2 proprietary and confidential
2 unauthorized (copying|reproduction|distribution) of this (file|document|material) (via any medium )?is strictly prohibited
"""


class Rule(NamedTuple):
    label: str
    literal: str
    priority: int
    regex: re.Pattern


def literal(parsed: _parser.SubPattern) -> str:
    """The longest run of characters that stands in every match."""
    runs, run = [], ""
    for op, value in parsed:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        runs.append(run)
        run = ""
        if op is _parser.SUBPATTERN:
            runs.append(literal(value[3]))
    return max(*runs, run, "", key=len)


def rules(table: str = TABLE) -> list[Rule]:
    out, label = [], ""
    for line in table.strip().splitlines():
        level, _, pattern = line.partition(" ")
        if not pattern:
            label = line
        else:
            out.append(Rule(label, literal(_parser.parse(pattern)), int(level), re.compile(rf"(?<![a-z0-9]){pattern}(?![a-z0-9])")))
    return out
