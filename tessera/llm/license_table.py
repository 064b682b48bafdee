"""Wordings of public licences besides those of ``license_rules``.

``SENTENCES`` are whole sentences by identifier (one or more spellings each), ``RULES`` licences and
their ordered sentences, earlier ones before later ones.  ``NAMES`` are the spellings of a licence's
name in a notice such as "This work is licensed under the ...", whose lead is ``LEAD``; ``TAGS`` are
the values of an ``SPDX-License-Identifier`` line.  All are normalised like the sentences of a text.
"""

from __future__ import annotations

_FSF = "as published by the free software foundation"
_MODIFY = "you can redistribute it and or modify it under the terms of the"
_LATER = "or at your option any later version"

_GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license",
        "agpl": "gnu affero general public license"}
_VERSIONS = {"gpl": ("2", "3"), "lgpl": ("2 1", "3"), "agpl": ("3",)}
_DATES = {("gpl", "2"): "version 2 june 1991", ("gpl", "3"): "version 3 29 june 2007",
          ("lgpl", "2 1"): "version 2 1 february 1999", ("lgpl", "3"): "version 3 29 june 2007",
          ("agpl", "3"): "version 3 19 november 2007"}


def _spdx(kind: str, version: str) -> str:
    return f"{kind.upper()}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"


SENTENCES: dict[str, str | tuple[str, ...]] = {
    "mit-title-long": ("the mit license", "the mit license mit", "mit license mit", "the mit licence", "mit licence"),
    "apache-title": "apache license",
    "apache2-date": ("version 2 0 january 2004", "version 2 0 january 2004 http www apache org licenses"),
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is "
                     "hereby granted provided that the above copyright notice and this permission notice appear in all "
                     "copies",
    "bsd-noendorse-author": tuple(
        f"neither the name of {who} nor the names of {whose} contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission"
        for who in ("the author", "the authors", "the copyright holders", "the copyright owner", "the organization",
                    "the university", "the copyright holder") for whose in ("its", "their", "any")
        if (who, whose) != ("the copyright holder", "its"))
    + tuple(f"{who} may not be used to endorse or promote products derived from this software without specific prior "
            "written permission" for who in ("the name of the author", "the names of the authors",
                                             "the names of its contributors", "the names of the contributors")),
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": tuple(f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0"
                       for x in ("http", "https")),
    "mpl2-title": "mozilla public license version 2 0",
    "epl2-terms": tuple("this program and the accompanying materials are made available under the terms of the eclipse public "
                        f"license {v} which {x}" for v in ("2 0", "v 2 0", "v2 0") for x in (
                            "accompanies this distribution and is available at https www eclipse org legal epl 2 0",
                            "is available at https www eclipse org legal epl 2 0",
                            "is available at http www eclipse org legal epl 2 0")),
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public "
                  "license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "cc0-title": ("cc0 1 0 universal", "creative commons cc0 1 0 universal"),
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
                   "and accompanying documentation covered by this license the software to use reproduce display distribute "
                   "execute and transmit the software and to prepare derivative works of the software and to permit third "
                   "parties to whom the software is furnished to do so all subject to the following",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and "
                  "to alter it and redistribute it freely subject to the following restrictions",
    "v2-later": f"either version 2 of the license {_LATER}",
    "v2.1-later": f"either version 2 1 of the license {_LATER}",
    "v3-later": f"either version 3 of the license {_LATER}",
    "v2-only": "version 2 of the license",
    "v2.1-only": "version 2 1 of the license",
    "v3-only": "version 3 of the license",
}
RULES: tuple = (
    ("MIT", ("mit-title-long", "mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-title", "apache2-date")),
    ("BSD-3-Clause", ("all-rights", "bsd-grant", "bsd-noendorse-author")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-noendorse-author")),
    ("ISC", ("isc-grant-and",)),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-terms",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("CC0-1.0", ("cc0-title",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-grant",)),
)

NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit licence", "mit", "mit x11 license", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0",
                   "apache software license version 2 0", "apache license version 2", "apache 2 license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause",
                     "revised bsd license"),
    "ISC": ("isc license",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0",
                "mpl version 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal",
                "creative commons cc0 1 0 universal license", "cc0 license", "cc0"),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license",),
}
for _kind, _name in _GNU.items():
    _short = (_kind, f"gnu {_kind}", _name, _name.removeprefix("gnu "))
    for _v in _VERSIONS[_kind]:
        _id, _of = _spdx(_kind, _v), _v.replace(" ", ".")
        _spelt = [f"{n} {x}" for n in _short for x in (f"version {_v}", f"v{_v}", _v, *(() if " " in _v else (f"v{_v} 0", f"{_v} 0")))]
        _spelt += [f"{n}v{_v}" for n in (_kind, f"gnu {_kind}")]
        NAMES[f"{_id}-only"] = (*_spelt, *(f"{s} {x}" for s in _spelt for x in ("only", "license")))
        NAMES[f"{_id}-or-later"] = tuple(f"{s} {x}" for s in _spelt for x in ("or later", "or any later version", _LATER))
        SENTENCES |= {f"{_kind}-terms": (f"{_MODIFY} {_name} {_FSF}",), f"{_kind}-title": _name,
                      f"{_kind}{_of}-date": _DATES[_kind, _v],
                      f"{_kind}{_of}-only": (f"{_MODIFY} {_name} {_FSF} version {_v} of the license",
                                             f"{_MODIFY} {_name} version {_v} {_FSF}")}
        if (_kind, _v) == ("gpl", "3"):
            _later = "gpl3-terms"  # among the sentences of license_rules
        else:
            _later = f"{_kind}{_of}-later"
            SENTENCES[_later] = f"{_MODIFY} {_name} {_FSF} either version {_v} of the license {_LATER}"
        RULES += ((f"{_id}-or-later", ("gpl-free", f"{_kind}-terms", f"v{_of}-later")),
                  (f"{_id}-or-later", (f"{_kind}-terms", f"v{_of}-later")),
                  (f"{_id}-or-later", ("gpl-free", _later)), (f"{_id}-or-later", (_later,)),
                  (f"{_id}-only", (f"{_kind}-terms", f"v{_of}-only")), (f"{_id}-only", (f"{_kind}{_of}-only",)))
# one sentence has one identifier: GPL and LGPL 3 bear the same date
SENTENCES.pop("lgpl3-date")
RULES += tuple((f"{_spdx(k, v)}-only", (f"{k}-title", "gpl3-date" if (k, v) == ("lgpl", "3") else f"{k}{v.replace(' ', '.')}-date"))
               for k, v in _DATES)
for _kind, _name in {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial",
                     "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike",
                     "by-nc-nd": "attribution noncommercial noderivatives"}.items():
    for _v, _tail in (("4.0", "international"), ("3.0", "unported")):
        _w, _k = _v.replace(".", " "), _kind.replace("-", " ")
        _spelt = [f"cc {_k} {_w}", f"creative commons {_k} {_w}", f"creative commons {_name} {_w}",
                  f"creative commons {_name} {_w} {_tail}"]
        _spelt += [x.replace("sharealike", "share alike").replace("noncommercial", "non commercial") for x in _spelt[2:]
                   if "sharealike" in x or "noncommercial" in x]
        NAMES[f"CC-{_kind.upper()}-{_v}"] = tuple(f"{s}{x}" for s in _spelt for x in ("", " license"))
#: Rules of one notice or tag, after all others.
NAMED = tuple((name, (f"{name}-ref",)) for name in NAMES)

#: What stands before the name of a licence in a notice.
LEAD = (r"^(?:(?:this|the) [a-z]+ (?:is|are) (?:free software )?|it is )?(?:dual )?"
        r"(?:licensed|released|distributed|published|provided|available|made available|covered) under "
        r"(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?")

TAG = "spdx license identifier"
_TAGGED = (*NAMES, "0BSD", "Artistic-2.0", "WTFPL", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "LGPL-2.0-only",
           "LGPL-2.0-or-later", "GPL-1.0-or-later", "MPL-1.1", "CDDL-1.0", "EUPL-1.2", "MIT-0", "OFL-1.1", "PSF-2.0",
           "PostgreSQL", "X11", "BSD-4-Clause", "CC-BY-2.0", "CC-BY-SA-2.0", "MIT OR Apache-2.0",
           "Apache-2.0 OR MIT")
#: Normalised value of a tag, and the licence reported for it; the bare GNU identifiers mean "only".
TAGS = {"".join(c if c.isalnum() else " " for c in x.lower()): f"{x}-only" if f"{x}-only" in NAMES else x for x in _TAGGED}
NAMED += tuple((name, (f"{name}-tag",)) for name in dict.fromkeys(TAGS.values()))
