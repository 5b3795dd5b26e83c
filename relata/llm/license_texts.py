"""What the licence classifier learns from: names, phrases and paragraphs of public licences."""

from __future__ import annotations

# Usual names of each family, the first one most common; an SPDX identifier comes last.
NAMES: dict[str, list[str]] = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL v3", "Affero GPL", "AGPLv3", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache License", "Apache 2.0", "Apache v2", "Apache-2.0"],
    "artistic-2.0": ["Artistic License 2.0", "Artistic License", "Perl Artistic License", "Artistic-2.0"],
    "bsd": ["BSD 3-Clause License", "3-Clause BSD License", "BSD 2-Clause License", "Simplified BSD License", "New BSD License", "BSD License", "BSD", "BSD-3-Clause", "BSD-2-Clause"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "Boost License", "BSL-1.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY", "CC-BY-4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons NonCommercial License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC", "CC-BY-NC-4.0"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons NoDerivs License", "CC BY-ND 4.0", "CC BY-ND", "CC-BY-ND-4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA", "CC-BY-SA-4.0"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero", "Creative Commons CC0 License", "CC0", "CC0-1.0"],
    "epl-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v 2.0", "Eclipse Public License 1.0", "Eclipse Public License", "EPL 2.0", "EPL-2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU General Public License", "GNU GPL v3", "GNU GPL", "GPL v2", "GPLv3", "GPLv2", "GPLv3 or later", "GPL-3.0-or-later", "GPL-2.0-only"],
    "isc": ["ISC License", "ISC license", "ISC"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL v3", "LGPLv2.1", "LGPL", "LGPL-2.1-or-later"],
    "mit": ["MIT License", "MIT/X11 License", "Expat License", "MIT licence", "MIT-style License", "MIT"],
    "mpl-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v. 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "wtfpl": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "zlib": ["zlib License", "zlib/libpng License", "Zlib"],
}

# Phrases that a name stands in. Those of HELD are kept from training, to calibrate on.
PHRASES = ["{}", "Released under the {}", "Licensed under the {}", "This work is licensed under the {}", "License: {}", "SPDX-License-Identifier: {}", "This project is distributed under the terms of the {}", "See the LICENSE file for the {}", "Code is available under {}", "Copyright (c) the authors. Licensed under {}.", "The code here is {} licensed", "Use is governed by a {} style license that can be found in the LICENSE file"]
HELD = ["This package is made available under the terms of the {}.", "You may use it under the {}", "The sources are covered by the {}", "license = {}", "Published under {} license, see COPYING"]

# Paragraphs of each family's text.
PARAGRAPHS: dict[str, list[str]] = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
    ],
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
    ],
    "artistic-2.0": ["You may use this Package under the terms of the Artistic License. You may Distribute verbatim copies of the Source form of the Standard Version of this Package in any medium without restriction, either gratis or for a Distributor Fee, provided that you duplicate all of the original copyright notices and associated disclaimers."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "bsl-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, unless such copies are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License. You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit, provide a link to the license, and indicate if changes were made. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. You may not use the material for commercial purposes. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. If you remix, transform, or build upon the material, you may not distribute the modified material. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/."],
    "cc0": [
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES',
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library. See the GNU Lesser General Public License for more details.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the company. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is licensed, not sold. All rights not expressly granted are reserved by the licensor.",
        "Copyright 2020 by the author, all rights reserved worldwide",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. You just do what the fuck you want to."],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
}

# Text that sounds alike and is no licence.
OTHER = [
    "a licensed driver", "the driver's licence was renewed", "a public library for all", "permission to land was granted", "the rights of the person", "source of the river", "free of charge for children", "a table reserved for two", "the warranty covers two years of repair", "the general public was invited", "she has a license to practise medicine",
    "the artistic director of the theatre", "a solar eclipse over the city", "the mozilla foundation and the apache helicopter", "a boost for the software industry", "creative people in the commons", "copyright law is taught here", "license", "licence", "copyright", "licensed", "permission", "a copy of the file", "the version of the document", "fishing license fees",
    "Copyright (c) 2021 Jane Doe", "Copyright 2019 The Authors", "terms and conditions apply", "see the license", "under the license", "the license of the bar was revoked", "with the permission of the author",
]
