"""Digests of whole licence texts in the canonical form of ``license_scan``.

Taken from the texts that Debian and Python packages carry, also under their usual titles. GPL and
LGPL texts stand under the name of the version alone.
"""

# SPDX name, first eight words, length and SHA-256 of the canonical text.
TEXTS = (
    ("Apache-2.0", "apache license version 2 0 january 2004 http", 8839, "9ce71eb31a8abf79414c431def165019f9604548c79edc94fe0d7d50b2f8703e"),
    ("Apache-2.0", "apache license version 2 0 january 2004 http", 8867, "37aa90548985ac0057637d42c3153e8b5d107a21d9556d7fbe60e3e426fdacaa"),
    ("Apache-2.0", "apache license version 2 0 january 2004 http", 9883, "dbb777d3ad1fb948fbe99e6748cbd3fea3f269381f3f7efe3f4259a28a9269c9"),
    ("Artistic-1.0-Perl", "the artistic license preamble the intent of this", 5823, "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-2-Clause", "bsd 2 clause license redistribution and use in", 1213, "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9"),
    ("BSD-2-Clause", "bsd 2 clause license redistribution and use in", 1215, "5d123f3d2076a6b22f7b17a92623627ef50d1584e8cf13b7d4040f1c6e8a0424"),
    ("BSD-2-Clause", "bsd 2 clause license redistribution and use in", 1217, "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms", 1192, "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms", 1194, "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms", 1196, "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374"),
    ("BSD-2-Clause", "the 2 clause bsd license redistribution and use", 1217, "4b12427c919036fc08e3d3d6bda2d2d0fed58212d4c5dfc57237af4a66887098"),
    ("BSD-2-Clause", "the 2 clause bsd license redistribution and use", 1219, "712dce7d673ff7e1550976bfd879c441ad93a2d9906c3c4ae27441d29fa3350b"),
    ("BSD-2-Clause", "the 2 clause bsd license redistribution and use", 1221, "18a4ded338bbc2e1519cd794de3c17e3d5fe9628e240824c584fecdebe777a72"),
    ("BSD-3-Clause", "bsd 3 clause license redistribution and use in", 1382, "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "bsd 3 clause license redistribution and use in", 1396, "1006daeb1324c9ad53d0df375b702acbce2d142c9f26dffdb4999842f48ee2f4"),
    ("BSD-3-Clause", "bsd 3 clause license redistribution and use in", 1399, "1e9eef4db1751b3ae8a4dcf0e099423200fc2acbba0f11dd8a9441b2bf87f686"),
    ("BSD-3-Clause", "bsd 3 clause license redistribution and use in", 1405, "907ca4d9e1b9f1f0223143275558eb7e180c2921a94eeb951ee099bef4515792"),
    ("BSD-3-Clause", "new bsd license redistribution and use in source", 1377, "6dd35bce98db3fa45a370b235b582cdcb2284ef2507066048a386c572223f19a"),
    ("BSD-3-Clause", "new bsd license redistribution and use in source", 1391, "e8a42affefb8967a820164e26156aed6d9bd512a6d3124b81268b4de552a250d"),
    ("BSD-3-Clause", "new bsd license redistribution and use in source", 1394, "792b3af8541a8f2f25ab651c95bd43fbc4152ca5515682ac90519b8fda84655f"),
    ("BSD-3-Clause", "new bsd license redistribution and use in source", 1400, "25944ff1e82949a76cc9647410ddc1920db62afb9ba24d60fda8caee6295686a"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", 1361, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", 1375, "549a0b4960f4ffdc99ff68cb9cd4c3e22cb7891b5fc166e37fbf5e344399dce2"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", 1378, "033277db679b3d4f47d218756716157e16923afce7d1363dd3ea9f564dd86142"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", 1384, "6e5bc7d06b9485f41b9e2e272443a94351b113b594b4615a14a64b741fc6d298"),
    ("BSD-3-Clause", "the 3 clause bsd license redistribution and use", 1386, "9cd680d56db42f3a510ba3089570ba3abf28066291ae57ecf32e4d67e6527310"),
    ("BSD-3-Clause", "the 3 clause bsd license redistribution and use", 1400, "f8ee7ddef53b6788d7fc73f0fac34c10faf8f5843fd1f7eb4d618f5130d8ebf3"),
    ("BSD-3-Clause", "the 3 clause bsd license redistribution and use", 1403, "cf9fea19504c6a22c8a429209096b0faf491f15645697459011a1d24ba61d15a"),
    ("BSD-3-Clause", "the 3 clause bsd license redistribution and use", 1409, "9722c723779d44d611759bb0fd8a113b34bd46d725cf5bc3b672ad2bf58e5763"),
    ("CC0-1.0", "creative commons legal code cc0 1 0 universal", 6698, "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
    ("GFDL-1.2-only", "gnu free documentation license version 1 2 november", 19583, "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.3-only", "gnu free documentation license version 1 3 3", 22013, "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
    ("GPL-1.0-only", "gnu general public license version 1 february 1989", 11764, "2b62a0899e7031347a9577241eb9b504d0eafb4d91b28e1f99580099701d0a1a"),
    ("GPL-2.0-only", "gnu general public license version 2 june 1991", 17115, "d3d1ea54d09952fcd9626a8c4c7c325e00c7f6febdc41bf004285919d6bfaa0a"),
    ("GPL-3.0-only", "gnu general public license version 3 29 june", 33400, "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06"),
    ("ISC", "isc license permission to use copy modify and", 691, "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", "permission to use copy modify and or distribute", 679, "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "the isc license permission to use copy modify", 695, "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("LGPL-2.0-only", "gnu library general public license version 2 june", 24127, "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.1-only", "gnu lesser general public license version 2 1", 25214, "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-3.0-only", "gnu lesser general public license version 3 29", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "mit license permission is hereby granted free of", 1000, "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "permission is hereby granted free of charge to", 988, "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "the mit license mit permission is hereby granted", 1008, "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "the mit license permission is hereby granted free", 1004, "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MPL-1.1", "mozilla public license version 1 1 1 definitions", 22449, "557aed17f246818803a7e59ebc965e6771b9df3a92fb2f3598e38d288d65fe4c"),
    ("MPL-2.0", "mozilla public license version 2 0 1 definitions", 14354, "2ad70b294c733e2c6f2cb0324503b9b81e060d33bc2608d3966776252c994426"),
    ("Zlib", "this software is provided as is without any", 784, "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
)
