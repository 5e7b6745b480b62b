"""Signature rules of the license scan.

A rule is ``priority | keyword | label | regex`` over words parted by single
blanks. Priority 1: a named version or identifier; 2: a family; 3: a mention of
licensing without a name. The keyword is a literal that every match contains.
"""

RULES = r"""
1|under the mit license|mit|under the mit license
1|mit license|mit|the mit license( mit)?
1|permission is hereby granted|mit|permission is hereby granted free of charge to any person obtaining a copy
2|mit license|mit|(licensed|released|distributed|available) under (an|the)? ?mit license
2|mit licen|mit|mit licen[cs]ed
2|expat|mit|expat licen[cs]e
1|without fee is hereby granted|mit-like|permission to use copy modify and distribute this software .{0,80}without fee is hereby granted
1|apache license version 2|apache-2|(the )?apache license version 2( 0)?
1|apache license 2|apache-2|apache license 2 0
1|apache 2|apache-2|(licensed|released|available) under (the )?apache 2( 0)?( license)?
1|apache org licenses|apache-2|(www )?apache org licenses license 2 0
1|apache license version 1|apache-1.1|(the )?apache license version 1 1
1|apache software license|apache-1.1|apache software license version 1 1
2|apache license|apache|(under|the) apache license
2|apache software license|apache|apache software license
1|cc by nc nd|cc-by-nc-nd|cc by nc nd( \d \d)?
1|cc by nc sa|cc-by-nc-sa|cc by nc sa( \d \d)?
1|cc by nc|cc-by-nc|cc by nc( \d \d)?
1|cc by nd|cc-by-nd|cc by nd( \d \d)?
1|cc by sa|cc-by-sa|cc by sa( \d \d)?
1|cc by|cc-by|cc by \d \d
1|cc0|cc0|cc0( 1 0)?( universal)?
1|creative commons zero|cc0|creative commons zero( v?1 0)?
1|attribution noncommercial noderiv|cc-by-nc-nd|(creative commons )?attribution noncommercial noderiv(ative)?s( \d \d)?
1|attribution noncommercial sharealike|cc-by-nc-sa|(creative commons )?attribution noncommercial sharealike( \d \d)?
1|attribution non commercial share alike|cc-by-nc-sa|(creative commons )?attribution non commercial share alike( \d \d)?
1|attribution noncommercial|cc-by-nc|(creative commons )?attribution noncommercial( \d \d)?
1|attribution non commercial|cc-by-nc|(creative commons )?attribution non commercial( \d \d)?
1|attribution noderiv|cc-by-nd|(creative commons )?attribution noderiv(ative)?s( \d \d)?
1|attribution sharealike|cc-by-sa|(creative commons )?attribution sharealike( \d \d)?
1|attribution share alike|cc-by-sa|(creative commons )?attribution share alike( \d \d)?
1|creative commons attribution|cc-by|creative commons attribution \d \d
2|creative commons attribution|cc-by|creative commons attribution( licen[cs]e)?
2|creative commons|creative-commons|creative commons licen[cs]es?
2|creativecommons org|creative-commons|creativecommons org licenses
1|creativecommons org licenses by nc nd|cc-by-nc-nd|creativecommons org licenses by nc nd( \d \d)?
1|creativecommons org licenses by nc sa|cc-by-nc-sa|creativecommons org licenses by nc sa( \d \d)?
1|creativecommons org licenses by nc|cc-by-nc|creativecommons org licenses by nc( \d \d)?
1|creativecommons org licenses by nd|cc-by-nd|creativecommons org licenses by nd( \d \d)?
1|creativecommons org licenses by sa|cc-by-sa|creativecommons org licenses by sa( \d \d)?
1|creativecommons org licenses by|cc-by|creativecommons org licenses by \d \d
1|creativecommons org publicdomain zero|cc0|creativecommons org publicdomain zero( 1 0)?
1|creativecommons org publicdomain mark|public-domain|creativecommons org publicdomain mark( 1 0)?
1|gnu affero general public license|agpl-3|gnu affero general public license (as published by the free software foundation )?(either )?(v|version )3( 0)?
2|gnu affero general public license|agpl|(the )?gnu affero general public license
1|agpl|agpl-3|agpl ?v?3( 0)?
2|agpl|agpl|agpl( licen[cs]ed?)?
1|gnu lesser general public license|lgpl-2.1|gnu lesser general public license (as published by the free software foundation )?(either )?(v|version )2 1
1|gnu lesser general public license|lgpl-3|gnu lesser general public license (as published by the free software foundation )?(either )?(v|version )3( 0)?
1|gnu library general public license|lgpl-2|gnu library general public license (as published by the free software foundation )?(either )?(v|version )2( 0)?
2|gnu lesser general public license|lgpl|(the )?gnu lesser general public license
2|gnu library general public license|lgpl|(the )?gnu library general public license
1|lgpl|lgpl-2.1|lgpl ?v?2 1
1|lgpl|lgpl-3|lgpl ?v?3( 0)?
2|lgpl|lgpl|lgpl( licen[cs]ed?)?
1|gnu general public license|gpl-2|gnu general public license (as published by the free software foundation )?(either )?(v|version )2( 0)?
1|gnu general public license|gpl-3|gnu general public license (as published by the free software foundation )?(either )?(v|version )3( 0)?
1|gnu general public license|gpl-1|gnu general public license (as published by the free software foundation )?(either )?(v|version )1( 0)?
2|gnu general public license|gpl|(the )?gnu general public license
1|gpl|gpl-2|gpl ?v?2( 0)?( only| or later)?
1|gpl|gpl-3|gpl ?v?3( 0)?( only| or later)?
2|gnu gpl|gpl|(the )?gnu gpl
2|under the gpl|gpl|under the gpl
1|gnu free documentation license|gfdl-1.1|gnu free documentation license version 1 1
1|gnu free documentation license|gfdl-1.2|gnu free documentation license version 1 2
1|gnu free documentation license|gfdl-1.3|gnu free documentation license version 1 3
2|gnu free documentation license|gfdl|(the )?gnu free documentation license
1|classpath exception|gpl-2-classpath|(gpl )?(with )?(the )?classpath exception
1|redistribution and use in source and binary forms|bsd|redistribution and use in source and binary forms with or without modification are permitted
1|2 clause bsd|bsd-2|2 clause bsd( licen[cs]e)?
1|bsd 2 clause|bsd-2|bsd 2 clause( licen[cs]e)?
1|simplified bsd|bsd-2|simplified bsd( licen[cs]e)?
1|freebsd license|bsd-2|freebsd license
1|3 clause bsd|bsd-3|3 clause bsd( licen[cs]e)?
1|bsd 3 clause|bsd-3|bsd 3 clause( licen[cs]e)?
1|new bsd|bsd-3|new bsd licen[cs]e
1|modified bsd|bsd-3|modified bsd licen[cs]e
1|neither the name of|bsd-3|neither the name of .{1,80}may be used to endorse or promote products
1|4 clause bsd|bsd-4|4 clause bsd( licen[cs]e)?
1|bsd 4 clause|bsd-4|bsd 4 clause( licen[cs]e)?
1|all advertising materials|bsd-4|all advertising materials mentioning features or use of this software
1|0bsd|0bsd|0bsd( licen[cs]e)?
1|zero clause bsd|0bsd|(bsd )?zero clause bsd
2|bsd licen|bsd|bsd licen[cs]ed?
2|bsd style|bsd|bsd style licen[cs]e
1|mozilla public license|mpl-1.0|mozilla public license (v|version )?1 0
1|mozilla public license|mpl-1.1|mozilla public license (v|version )?1 1
1|mozilla public license|mpl-2.0|mozilla public license (v|version )?2( 0)?
1|mozilla org mpl|mpl-2.0|mozilla org mpl 2 0
2|mozilla public license|mpl|(the )?mozilla public license
1|mpl|mpl-2.0|mpl 2 0
1|eclipse public license|epl-1.0|eclipse public license (v|version )?1( 0)?
1|eclipse public license|epl-2.0|eclipse public license (v|version )?2( 0)?
2|eclipse public license|epl|(the )?eclipse public license
1|eclipse distribution license|bsd-3|eclipse distribution license (v|version )?1( 0)?
1|common development and distribution license|cddl-1.0|common development and distribution license (v|version )?1 0
1|common development and distribution license|cddl-1.1|common development and distribution license (v|version )?1 1
2|common development and distribution license|cddl|common development and distribution license
2|cddl|cddl|cddl( licen[cs]e)?
1|common public license|cpl-1.0|common public license (v|version )?1 0
2|common public license|cpl|common public license
1|ibm public license|ipl-1.0|ibm public license( (v|version )?1 0)?
1|artistic license|artistic-1|artistic license 1 0
1|artistic license|artistic-2|artistic license 2 0
2|artistic license|artistic|(the )?artistic license
2|same terms as perl|artistic-or-gpl|(under )?the same terms as perl( itself)?
1|python software foundation license|psf-2|python software foundation license (v|version )2
2|python software foundation license|psf|python software foundation license
1|php license|php-3.01|php license (v|version )?3 01
2|php license|php|(the )?php license
2|ruby license|ruby|(the )?ruby license
1|zlib|zlib|zlib( libpng)? licen[cs]e
1|this software is provided as is without any express or implied warranty|zlib|this software is provided as is without any express or implied warranty in no event will the authors be held liable
2|libpng license|libpng|libpng license
1|isc license|isc|(the )?isc license
2|isc licensed|isc|isc licensed
1|boost software license|bsl-1.0|boost software license( (v|version )?1 0)?
1|business source license|busl-1.1|business source license( (v|version )?1 1)?
1|unlicense|unlicense|(the )?unlicense
1|free and unencumbered software|unlicense|this is free and unencumbered software released into the public domain
1|do what the fuck you want|wtfpl|do what the fuck you want to public license( version 2)?
2|wtfpl|wtfpl|wtfpl
1|beerware|beerware|(the )?beerware licen[cs]e
1|beer ware|beerware|the beer ware licen[cs]e
2|public domain|public-domain|(is|are|released|placed|dedicated) (in|into|to) the public domain
2|public domain|public-domain|public domain dedication
1|european union public licen|eupl-1.1|european union public licen[cs]e (v|version )?1 1
1|european union public licen|eupl-1.2|european union public licen[cs]e (v|version )?1 2
2|european union public licen|eupl|european union public licen[cs]e
2|cecill|cecill|cecill( [bc])?( (free )?(software )?licen[cs]e)?
1|microsoft public license|ms-pl|microsoft public license
1|microsoft reciprocal license|ms-rl|microsoft reciprocal license
1|open software license|osl-3.0|open software license (v|version )?3 0
2|open software license|osl|(the )?open software license
1|academic free license|afl-3.0|academic free license (v|version )?3 0
2|academic free license|afl|(the )?academic free license
1|open database licen|odbl-1.0|open database licen[cs]e( (v|version )?1 0)?
1|odbl|odbl-1.0|odbl( 1 0)?
1|open data commons attribution|odc-by|open data commons attribution licen[cs]e
1|public domain dedication and license|pddl|public domain dedication and license
1|sil open font license|ofl-1.1|sil open font license( (v|version )?1 1)?
2|open font license|ofl|(the )?open font license
1|universal permissive license|upl-1.0|universal permissive license( (v|version )?1 0)?
1|server side public license|sspl-1|server side public license( (v|version )?1( 0)?)?
1|elastic license|elastic-2|elastic license (v|version )?2( 0)?
2|elastic license|elastic|(the )?elastic license
1|commons clause|commons-clause|commons clause( licen[cs]e)?( condition)?
1|redis source available license|rsal|redis source available license
1|polyform noncommercial|polyform-nc|polyform noncommercial( licen[cs]e)?( 1 0 0)?
1|polyform small business|polyform-sb|polyform small business( licen[cs]e)?( 1 0 0)?
1|mulan psl|mulan-psl-2|mulan psl ?v?2
1|mulan permissive software license|mulan-psl-2|mulan permissive software license( v?2)?
1|blue oak model license|blueoak-1|blue oak model license( 1 0 0)?
1|vim license|vim|(the )?vim license
1|openssl license|openssl|(the )?openssl license
1|ssleay license|openssl|(original )?ssleay license
1|postgresql license|postgresql|(the )?postgresql license
1|ncsa open source license|ncsa|(university of illinois )?ncsa open source license
1|w3c software|w3c|w3c software (notice and )?license
1|x11 license|x11|(the )?x11 license
1|latex project public license|lppl-1.3|latex project public license (v|version )?1 3[a-c]?
2|latex project public license|lppl|latex project public license
1|sun public license|spl-1.0|sun public license( (v|version )?1 0)?
1|sleepycat license|sleepycat|(the )?sleepycat license
1|apple public source license|apsl-2|apple public source license( (v|version )?2 0)?
1|netscape public license|npl-1.1|netscape public license( (v|version )?1 [01])?
1|q public license|qpl-1.0|q public license( (v|version )?1 0)?
1|nvidia source code license|nvidia|nvidia source code license
1|llama 2 community license|llama-2|llama 2 community license( agreement)?
1|llama 3 community license|llama-3|(meta )?llama 3 community license( agreement)?
1|rail|openrail|(creativeml )?(big ?science )?open ?rail( ?m)?( licen[cs]e)?
1|hippocratic license|hippocratic|hippocratic license( (v|version )?\d( \d)?)?
1|json license|json|(the )?json license
1|shall be used for good not evil|json|the software shall be used for good not evil
1|eiffel forum license|efl-2|eiffel forum license( (v|version )?[12])?
1|fair license|fair|(the )?fair license
1|open government licence|ogl-3|open government licence (v|version )?3 0
2|open government licence|ogl|open government licence
1|licence ouverte|etalab-2|(etalab )?licence ouverte( etalab)?( 2 0)?
1|datenlizenz deutschland|dl-de-by-2|datenlizenz deutschland namensnennung( (version )?2 0)?
2|lizenziert unter|licensed|lizenziert unter( der)?
2|licencia mit|mit|licencia mit
2|licence mit|mit|(sous )?licence mit
2|licencia apache|apache|licencia apache
2|licence apache|apache|(sous )?licence apache
2|licence publique g|gpl|licence publique g[^ ]+ gnu
2|licencia p|gpl|licencia p[^ ]+ general de gnu
2|all rights reserved|all-rights-reserved|all rights reserved
2|tous droits r|all-rights-reserved|tous droits r[^ ]+s
2|todos los derechos reservados|all-rights-reserved|todos los derechos reservados
2|alle rechte vorbehalten|all-rights-reserved|alle rechte vorbehalten
2|proprietary and confidential|proprietary|proprietary and confidential
2|commercial license|commercial|(a|the|under) commercial license
2|non commercial use only|non-commercial|(for )?non commercial use only
2|noncommercial use only|non-commercial|(for )?noncommercial use only
2|dual licensed|dual|dual licensed( under)?
3|licensed under|licensed|licensed under( the)?( [^ ]+){1,3}
3|licenced under|licensed|licenced under( the)?( [^ ]+){1,3}
3|released under|licensed|released under the( [^ ]+){1,3} licen[cs]e
3|see license|licensed|see license( file)?( for details)?
3|see the license|licensed|see the license( file)?( for details)?
3|license file|licensed|(see |in )?(the )?license file
3|terms of the|licensed|(under )?the terms of the( [^ ]+){1,4} licen[cs]e
3|copyright|copyright|copyright (c )?\d{4}
"""

#: Identifiers of the SPDX list; each makes a rule "spdx license identifier ID".
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause
BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0
CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
Elastic-2.0 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL
MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 OpenSSL PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 QPL-1.0 Ruby SSPL-1.0 UPL-1.0
Unlicense Vim W3C WTFPL X11 Zlib
"""


def rules() -> list[tuple[int, int, str, str, str]]:
    """(number, priority, keyword, label, regex), in order."""
    rows = [line.split("|", 3) for line in RULES.strip().splitlines()]
    out = [(int(p), k, label, x) for p, k, label, x in rows]
    for name in SPDX.split():
        words = " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())
        out.append((1, f"spdx license identifier {words}", name.lower(), f"spdx license identifier {words}"))
    return [(i, *r) for i, r in enumerate(out)]
