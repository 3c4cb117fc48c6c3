"""Hashes of the normalised sentences of whole licences, in order: twelve hexadecimal digits each, made by ``licenses.sentence_hashes`` from the licences' public texts."""

WHOLE: dict[str, str] = {
    "Apache-2.0": (
        "b510d5ccd916dd551e3eddd4c05aab35ca302681ff6a0f19e44296d62980824ceac1d65ac046874294d39bf4f8a1e460d422e3b6b59f32ea80182960527a55524e1a03077542dde1"
        "bf22a8c62b25e6c98bf96fb02ec1bfbfb1898d5af575fb5b234593646e37b3cb05f3a75cc63ca1bae4e6e6c24b14bf1dd629c1e555a79628dd04fe7279f8e07c9feb530c0381b96d"
        "b0cbdc4c6cf19b2b60be87f58e51c3bb9af8c278dbff3ee5663efacbed0e20e0a075b6cc7d834dc13bdd14e9f8b70ac2c1fe6fb3d09e83f68a4c1edf8cecb8a4d3f6ca13a1b091df"
        "d3e87aeb27d0facc29fbeb603fc361358da64b5298b242f1c4ef05d6e70e9cd952f8b3e22c14f19ae64ed912ad47496f39d68f5c39db3b34dd3447a31919e7e368fe0b7379ab2049"
    ),
    "Artistic-1.0": (
        "108304aa3cabbee553a2884b21571fb1c9b53a0a6b5b2b7554f7a4a877b915a9cc778c3444200390254dac152521fbc5043b50db5e5ed557a59033732236cf1804d02fb7214c7ea5"
        "084ddd3b05dc27d9854752c4e2ec867a3efc60dcd4723aa18d787543953b1ab2f16745992ceb28021631d2e8df3d0194bf784533ae30274426c41d9947e030c86bb0a54fc03edca9"
        "491a0908e250e2a777c6dd428173772e226a4258d56302636a5545f5c98ec7522625fd36d9f7792cc82f7b046852c4428e62c72aa230ad1386afd4eaede3a5db32b7"
    ),
    "CC0-1.0": (
        "06adbb10446f8f6b31e960635a540a2e287f3177d63d839332bd8b3c5d370e145880887aa8661d30235bbbd213478acdb526d0fba7c316f76b31361a4e11bc2851dd35d4322bb3b8"
        "3a9ee41b27bcf892f22b1406c49bf7a6f2f725df1833d9914838cba04337a247dece1b522cf9e15cf91ea5d9ac181beeff6fc0cb4f524e7ecc84c56f7579bfa7286ea220403f1016"
        "e1d1c84282e8bf1175049eab0b3d74c5d18cf4fa673e4f3e9a66c9700b2e091e2c5a318c802fde324e26"
    ),
    "GFDL-1.2": (
        "b0814a9dd9a521c09aa490c0c357e737ead6b8e5c53e1fbc4e58ca7e18faa718c18d67465f818d56075361005de726f74c705988a4ba022bfcfcaa9b8148cfce34e2e09e60ad9e87"
        "f026ad44a5ca0860c76a4521b28d5177228119c912f440ee31af3ac73ac416b8b352ed13c00986d777971f93dc2fb706449117ad75473743abdba41b4254eb77740c44f9912dd960"
        "0dc7b1baf01ab3039c238a22b2d92d0511aa4828c43fc9ad23a0df3835afc1db332a91626f9969bc05509bbb605f2fbfb29706b219ca36994e0145c8a13962e3e7c06165a6ec2e31"
        "9c72a04b3c83b9dbc1e1f31348360aa50ba9bac8037e0488caf657548a947eb060c0baaca766c7dd1e12da0d4f99d4c3bf156b279eae124911da3fd73b596f1235847e6d4af1aab0"
        "e782ecce6892db0b4f47c8542cc9bbfc85e19921f1ca6a483bcdca8b980676a95a6014663cf19120993dcad931c685aae51f0c21ee204eeec0c7d1372c27a6ae506471dbebf02d74"
        "30e662184d8a4186818a3aee92d84c9f37a8d18d3ce3a33f20c1a73423293b14a53af7933cf39b1cd03f10ee22c2ca1c68b1545fa3c55a6101b09b52a3db797bca1d86417eb369aa"
        "262d3420dd2d3cb374c07e38ec0c3b1d4dbc2d6e9bfd243e8e7c4920e928f7d0a6b1391e9ec5a57204783c15b276663ee97c4011c32b081c4251582ac6b1c74714472d80717cce96"
        "db5897af6c3ff76e30638c457bbc32169432a70ee809aebdecc2ce2b557c071ebada426ccfc74f2dbf04651dfade54748550c2c2c279e42b4242d33a25eb98fccb4e5e351785153f"
        "c7d0ce0b649f4598ad4a0c8e17ede172c109e8c200da89407203ba8a38ab0d2d09bf8920c543b68a85fe0b2900572a470cff97909fe2173e5bb9a7d4373610485bd346aed70c2f80"
        "a108eb68b61d034263fcc2bf731462bc4d20d95bf5e6df9ccd2e4cee681375e9c316b40323d5e48fb2d21e9711bcb229d177855d3e0a75f01734a7af5a54f780bda573a8a30907f2"
        "2386a123b47a35082588d4a5d33bf5447b67c5ec139333f5"
    ),
    "GFDL-1.3": (
        "464ef282480b0cfc52a46c98cc225fdb3201b8e5c53e1fbc4e58ca7e18faa718c18d67465f818d56075361005de726f74c705988a4ba022bfcfcaa9b8148cfce34e2e09e60ad9e87"
        "f026ad44a5ca0860c76a4521b28d5177228119c912f440ee31af3ac73ac416b8b352ed13c00986d777971f93dc2fb706449117ad75473743abdba41b4254eb77740c44f9912dd960"
        "0dc7b1baf01ab3039c238a22b2d92d0511aa4828c43fc9ad23a0df3835afc1db332a91626f9969bc05509bbb605f2fbfb29706b219ca36994e0145c8a13962e3e7c0ee06af795fd6"
        "6165a6ec2e319c72a04b3c83b9dbc1e1f31348360aa50ba9bac8037e0488caf657548a947eb060c0baaca766c7dd1e12da0d4f99d4c3bf156b279eae124911da3fd73b596f123584"
        "7e6d4af1aab0e782ecce6892db0b4f47c8542cc9bbfc85e19921f1ca6a483bcdca8b980676a95a6014663cf19120993dcad931c685aae51f0c21ee204eeec0c7d1372c27a6ae5064"
        "71dbebf02d7430e662184d8a4186818a3aee92d84c9f37a8d18d3ce3a33f20c1a73423293b14a53af7933cf39b1cd03f10ee22c2ca1c68b1545fa3c55a6101b09b52a3db797bca1d"
        "86417eb369aa262d3420dd2d3cb374c07e38ec0c3b1d4dbc2d6e9bfd243e8e7c4920e928f7d0a6b1391e9ec5a57204783c15b276663ee97c4011c32b081c4251582ac6b1c7471447"
        "2d80717cce96db5897af6c3ff76e30638c457bbc32169432a70ee809aebdecc2ce2b557c071ebada426ccfc74f2dbf04651dfade54748550c2c2c279e42b4242d33a25eb98fccb4e"
        "5e351785153fc7d0ce0b649f4598ad4a0c8e17ede172c109e8c200da89407203ba8a38ab0d2d09bf8920c543b68a85fe0b2900572a47c21f6e92ae5251d184ad63b8e17a2e920176"
        "8d6f9032f11d1e05c83dadf1b5980f86536746aed70c2f80a108eb68b61d034263fcc2bf731462bc4d20d95bf5e6df9ccd2e4cee681375e9c316b4039efe5b89c62c93c2609a6468"
        "5fa6b63ade09138aad0e15dfa8472381b7a50cc0c585535f9d9d4084ab2d282089d542c123d5e48fb2d21e9711bcb229d177855d3e0ad885bc5469f15a54f780bda573a8a30907f2"
        "2386a123b47a35082588d4a5d33bf5447b67c5ec139333f5"
    ),
    "GPL-1.0": (
        "ba9af78cdf2b825b405e390f49a238152c04f6b97a9d1c07889c636399c961c2bfc05e74e8b2ec44cb7bb0d3e8891bf3edc592bb20bb0f1b467d9379582a706b5c15c18fd40ee5ff"
        "4ab2b77fcf90973fbf651dea4514cc17dca52f6a052c7e6a9f309c598b1e154cefde844e0a6ca23b2cf8a87788473c634e601e96aa39f5de03f13e815d4ef0018d073da30e449b59"
        "807037e7aa5396a25f57ec4dfef7d68353af4799db23d8790efa103a3e07e584013769e476fa373f91c731022f45adc93814177f8018b855f02c9bb51108ae7ac139847591e4ed0a"
        "1f8d0cee543a8c4742a5052c798a11a38031701353f7bce1f05fc7aca1f98e5d41d41482b1134a540daacc22612a3ee38817adb531bb2e857fe031caf5e30ca65f5a22807cb967ad"
        "38640773643b034263fcc2bfb51009574f8d785a95f9502ed1519a7d4250cab5f61f3d20e29200626f3ac02cb22fc17767d632ef12087129530e950b99db34150f9d47cfec92745d"
        "2911d8569b54e7446c8276cfbb7ca6619e7f60290c98689af5be3b1efe8434b1a57a46862683db78b620361c7a9e8d8563e04c7f7d80d9fdf088e0438152ae2ada6e500a6e1aca1a"
        "ae15e5bc63e75a4cbd95f73faac168fedcede7d372c1151e73d3e25cc1534d09ed86512783e06860f9b1f81044f6d635d1ea12e2f31e453cc9e6b656d203346c75fee74b39ee6e4b"
    ),
    "GPL-2.0": (
        "2efaf68dc8526496272f60883458f9c9eac645de463a2e5351e2d15b0808869e602bca5dedc592bb20bb5348f99452c8582a706b5c15c18fd40ee5ff4ab2b77fcf9023e1ea2f4bb2"
        "4514cc17dca59266174425bf9f309c598b1e154cefde844e0a6ca23b2cf8265eda3717c0efbdb230b62c7f1f5b998e7aa87788473c634e601e96aa39fc5881067a2ff0b6249264eb"
        "2615e296a7a274f185f11f28df6ee858b54f3ee67f159be1dbb302f3b741902e6553c81c807037e7aa53fcb98c157a22f2c12e1e84e765ecd61db9b0e09775934096bdefa1652be5"
        "1f5f1525dbc7a68b3694d4e1fb8f8b8e27064dc527a660eff4c527c9165b2409e1b076bf07efd0c37c8135ab3a557e84a613239f156c4d4aa2da6c56deb3c0ab322d5d96cc38f8e2"
        "819907b1d9fb9953dc298f43a318aff2f53813bb0860025667131a7016c72a43a7ea7c20259623f7f0f3108bd401ae91373610485bd339ad47337f932cf7363755651f373d62c405"
        "2460a96fbbe5f5e30ca65f5a22807cb967ad280b61580e649ed2bd776796efeb34e87a484abf6ef684088e3bbb2d3252f073e1e9e667258e7699b107fc1603109efd049aa399abc3"
        "58214febefe2eb55fa5f2ef510bff12ceed738640773643b034263fcc2bfb51009574f8d8dbf9b9ac8956f500a741435cab5f61f3d20e29200626f3ac02cb22fc17767d632ef1208"
        "7129530e950b99db34150f9d47cfec92745d2911d8569b54e7446c8276cf4b5298b242f1a66fb66cb42546e74ddb8d36f5be3b1efe8434b1a57a46862683db78b620650aa4800bec"
        "63e04c7f7d80d9fdf088e0438152ae2ada6e500a6e1aca1ab4c8c4b0ff9a5a4cbd95f73faac168fedced1b7ee1241d3a73d3e25cc1534d09ed86512783e06860f9b1f81044f6d635"
        "d1ea12e2f31e7bfd144abf6fd203346c75fe12c10b0e87a2840cd76a30ce30490d63e758"
    ),
    "GPL-3.0": (
        "e3811b241bd82e2a6784328dcc225fdb320140a89dfa55eedc4cfb0f4e41c3dd4424599f44a44a3b008633ea54ecc8c23fca63524e2aedc592bb20bbe98360196dc45a768faf2a25"
        "0dc50382654a907ab9d56edd4514cc17dca59266174425bfe4ea9674bfc2b3678670273fb6cfd2b5a5ef082c75981bf346c935118de760e38ac3f74a4aa5f6ebb5b26244caec7a99"
        "ec016955d3ae4eefa44bd7c724ce0a339229549aba28fba4a87788473c63fdf0a7e973110b3ccce0de0ebf002c0a47783da30e449b59e89adfee941920132c8b67ea783d7b3b1a78"
        "b2898d214c6cbbb4461360d2e298954beba8c754a8268b619f175c221b2e2c670ffdb3b866551c2b4098a318aff2f538630fa3883b82c1f7760e2b9210bbb793cc89d3917819ce1f"
        "e3544aace59efba1c14af806aef94f45ecc39efa4d949df019a6e5687c37ca5959fea4f8d5c329fff67aa78f9ff8d7345bd7df32f8e4947016e64a7f499943378c4e246684a5b98b"
        "1be07caf91b767eca0f3df8c18d1d6e63061ad921aace91386fc0f8c3451876a0ecff11584bda6801084b04aa8c278415e7eeb711791c861713a805dae8b44bbe2b0648a6f0f70c8"
        "4aaf162c40339d0b0e91ac8a0ce5ee58af47ce6bed11e0e806cdefda4ff0d01c6cbaf60805fcf19b864828986e4c509d08e3cf60f1fd9430dd8dc5e124dd3eaf4464d763e71200e1"
        "ebc317b36a97bf632765d0ae9b6483d43ef49cd73aa1df334bf1b66bbd9f0c831cb100a2709c69dfa05c5fac23a181c09299d40f4ecf68153ae6dd247df312c8dd1473494a4155d8"
        "9652f643964c94752e4c0307fcf18c3e30967200b40be4f2d941a1b4341012b693127d4d88efe17e9310e743bb722f47536d68c68486c16d2a010e07fc3b53539e4b5f63afe4f79b"
        "f09bd02fb379c127c38722b5e4e1f4eae7ea53bdac9fe56a484d2ce48975a45de28df74d4b76d402bb691604271f8fa3e28b37c69497b529fca458e5324ac69a438e879ca86c90b2"
        "417689732f60c8e4b7376e4fde03ca67a78823d80cb22d62cfbe71a690995d2506e1dffdb0c47b0c345de17a2e9201768d6f9032f11d1e05c83dadf1c168c7a76f875b421d866c4c"
        "d38de021d4d99aabd434caa51a8d998d394ee2729bc863f995e069a4c9967ea4872ef72d9f7d3edb21a212b7c7d900c5532047c76c0d2675a0608fc2f14756e01faf296c813e3b2c"
        "8fe55ad5cbfb8821f042f8f9ace225931abd8922fb9b6abca3794cf9e017d6d0165fd10810a516d9cd373a63c17c5669474911b14dcf303f39106479c6d5e1e7aaf2224de7465216"
        "17e34b8d1727561fd024dfccd02af316becfcba4b5466139367d619b0a9a74a1be914b1e75a567835811c518603ce17cacde86ae84d148d65a031476034263fcc2bfb51009574f8d"
        "a23e818d4356e80634f7cbfd12b3ed73bd0ae7d2c22940d2663da0f4b7289cde0613e02e99db34150f9d47cfec92745d2911d8569b543989a02d2b426925ea656f65a8be38555391"
        "4b5298b242f1a66fb66cb42546e74ddb8d36f5be3b1efe84c4a0584b1cb22683db78b620650aa4800bec8152ae2ada6e500a6e1aca1afdcf80c028365a4cbd95f73faa278b65c5c4"
        "f074493e47a973d3e25cc1534d09ed8651278876a03a6280f1e8b06d2ea6ff0eb0a8e9b68a0afa9c302118c1272bb7a3840cd76a30ce30490d63e75807181a1015b3"
    ),
    "LGPL-2.0": (
        "4555376b416734308f044c5569eedc3d5a1bc4d50e7263f9fc44c65481c53458f9c9eac6f5893fa12c1b3561878977211fe703e35e2dedc592bb20bb5348f99452c8582a706b5c15"
        "c18fd40ee5ffa83941ed2ec8164b42de40c54514cc17dca59054b7553e799266174425bf6c4a0d52300e27641b28c1fed885d83f31f2265eda3717c0b89d94237d427f1f5b998e7a"
        "d30b399cf18925d461b9ec1707cd6004c5e974f851fddf72fbdbc8eb52531df53bd1870235f06427d7f85547ad5b1c8bfd8677a907a1be08c2d5d7a11e7ce82d723938bc349f96a7"
        "a87788473c6374021013ce3c6cedd699a97e10455106b9ede02ffca73c4fe856bc51a0dc3da30e449b59562ae34be3fb314fb3b36a413223e3da8f022843143dc64e701353f7bce1"
        "875b5e424798df6ee858b54f3ee67f159be197fce3ee22b6fe00d8c0292ed7f07179ac5efcb98c157a2276504e7c16a365ecd61db9b090df429d953e2f218468ea8019baa3ee3baf"
        "c9f18bd1e13c25f1c70456c542de4385a49285d0aa91cb134dc527a660ef26fc0d6459670c399ca8378807efd0c37c81e1fc99a234f21b6d82763bbcbb89741847be0409a59720a8"
        "cef4cee7dd16b2cae9f1a394d93ead98c5f0c59623d3f957826c6fb1ae4931821485c2c7ee5612b14990c10019e5e7e7dcc10d2964d10441e3bd5f51e20566c1a8c3f623fac9116d"
        "28281c10c166313c2a61f641409b4cc9d94f5168c1fe04f0d992fb2b3379bf7d700346a88cfcaa2ed8addf0be77306310c214828c456ebb2fd09fae6db784d58e987b5e8a2fe5016"
        "611fc5b194aa90dc772a10a23b079a4190f6ab31a6c6cdf5650639c8a56467131a7016c760dafe51b19c95564ffd167ef9f30178066608474f5a9ff8232ecafc090c0b2458df8bb2"
        "34c2387cbf081343024df2ed373610485bd339ad47337f93987c74a4920c1f373d62c40572a99314b7f59bd65dbedad422807cb967ad280b61580e649ed2bd776796f7b73157862a"
        "0f21f3362070d88c88dcb789f073e1e9e667a28d33aedb70fc1603109efd049aa399abc358214febefe225210316804110bff12ceed7ec9cad8f7970034263fcc2bfb51009574f8d"
        "62a061780b46c077ad19c4a55e8eccdd9784e29200626f3ac02cb22fc17767d632ef1208dd854259536ebb392a5fc522ec135324446d8769d655355566713c64f1b9495237f591f4"
        "a1869fac5fc1e04fc31ea8c8929f7aa6715334b1a57a46862683db78b62053d785912e3f04593971e519ddb9dc9fc8e38152ae2ada6e1d7b9e9fb410b4c8c4b0ff9a5a4cbd95f73f"
        "5cb8e9ca5678940a23324ab84619a94fa74ae74b39ee6e4b"
    ),
    "LGPL-2.1": (
        "9f15881d5e991ebb98e644da69eedc3d5a1b982cf086065de58ac55bb6973458f9c9eac6f5893fa12c1b3fded137bc08e8766e63076ddb6dacdf6b2fad66265239024e452ef1c57e"
        "6268a7ddfa2599e352cbd13372b4688b67f1b8d9c80b11b6164b42de40c54514cc17dca56aaefce5c3779266174425bfe5fda1481a1ff9d7b98beb5dbf17ae7d48cb8ef2858a0a77"
        "703439aeb19e0029abe3518f505e4e6278e121b00b782e2f8214007d12110ac252bf803a412c11814058d77dd467877f41331db2963a7031d588ce5f097276efe5f1ebf7fb34ec28"
        "d5919ee0e0d1b01b37faf260c309d8e03cfb103a85386cfe6df3d5cecdbcab54e908d82135f507c7fbdca87788473c6374021013ce3cb6cb7a9896d18799275e4372a127027babe5"
        "3da30e449b59562ae34be3fb314fb3b36a413223e3da8f022843143dc64e701353f7bce1875b5e424798df6ee858b54f3ee67f159be197fce3ee22b6fe00d8c0292ed7f07179ac5e"
        "fcb98c157a2276504e7c16a365ecd61db9b090df429d953e2f218468ea8019baa3ee3bafc9f18bd1e13c25f1c70456c542de4385a49285d0aa91cb134dc527a660ef26fc0d645967"
        "0c399ca8378807efd0c37c81e1fc99a234f21b6d82763bbcbb89741847be0409a59720a8cef4cee7dd16b2cae9f1a394d93ead98c5f0c59623d3f957826c6fb1ae4931821485c2c7"
        "ee5612b14990c10019e5e7e7dcc10d2964d10441e3bd5f51e20566c1a8c3f623fac9116d28281c10c166313c2a61f641409b4cc9d94f5168c1fe04f0d992fb2b337910271959f00a"
        "8cfcaa2ed8addf0be77306310c214828c456ebb2fd09fae6db784d58e987b5e8a2fe5016611fc5b194aad15848304bd2e8e1197644b9e5108b16eb3af2cfebca6310040849447ba9"
        "650639c8a564adb74ec5e5c160dafe51b19c95564ffd167ef9f30178066608474f5a9ff8232ecafc090c0b2458df8bb234c2387cbf081343024df2ed373610485bd339ad47337f93"
        "987c74a4920c1f373d62c40572a99314b7f59bd65dbedad422807cb967ad12b7c7d900c59ed2bd776796f7b73157862a0f21f3362070d88c88dcb789f073e1e9e667a28d33aedb70"
        "fc1603109efd049aa399abc358214febefe225210316804110bff12ceed7425b187a32c5034263fcc2bfb51009574f8d62a061780b46c077ad19c4a55e8eccdd9784e29200626f3a"
        "c02cb22fc17767d632ef1208dd854259536ebb392a5fc522ec135324446d8769d655355566713c64f1b9495237f591f4a1869fac5fc1e04fc31ea8c8929f7aa6715334b1a57a4686"
        "2683db78b62053d785912e3f04593971e519ddff919566b98152ae2ada6e01b005bc7967b4c8c4b0ff9a5a4cbd95f73f5cb8e9ca5678940a23324ab84619a94fa74ae74b39ee6e4b"
    ),
    "LGPL-3.0": (
        "c0063a87e54c2e2a6784328dcc225fdb3201602cee1737d88c7271146f9cb6d9ba11fec71721909c0bb43ca02b353beb384df1c6482fa499a6d6f2bd99c53eb0d1d3eada2da43043"
        "55faf5d009cacc878b8c6a0dd87bc407394252e3d8e1dc7f423c63cb405d5baeffbab779cec08e834e7e0d8f6a374c49d9770d5c719669cc1833706791c6493c6e85a26155c5be2a"
        "79bb17ce685b8af520f483b7074dc38d6734a450c5eb0c0b86a41a89c25fc3a43ed1bb9a850e540df04ca5ffca5de215a8ca5378966f99943e36c703fbd3182a5d7ed13501dc16b0"
        "63466ec0b7f09fc4ddc81aa0b49af239a511034263fcc2bfb51009574f8d43c2f0be7710b4ea56bb456e85d6bbaa70c3"
    ),
    "MPL-1.1": (
        "e702b8a03047464903a618c79ed66b42a3dfb5195673f79e2f6aa841db20bef97b63e863c5e5cd34b052efb157c89367e357298ab0efeef5163c5f90b6ccab06abab7f9e8307e14a"
        "154142b4506689df3b6399ee2e6587f999ca41d15c248251db40a6863f24f43e922794a7382981a398a2089dd8de6becd1b8f6f4239bc78f584b7ce2b2fa8f73ce76ccc3f7f83af9"
        "fd647b44c3d4fb850d98fa7efbeda37e6ca871111c06adcddbe16c3ac22f4ccb3091856e2034d07d1ad6a119c4a9199684429ed28f7fc54e9c3b31f6584647566f958df79269ae1d"
        "7fa89ae23be2b93c493160d2a01d7490cbbbb7633db29d57955e07ff6d78440d0c1ec0e99809315003407dd465ac4cd797a334c9aa1255e4c1531d5595c761a9d02df15dfd354e09"
        "2da993245cd9ccb7ae503e626fd7c0c6f23b9588e0757616c4f92b8be73ac80d8e3f5536701993eab949b03dc0532553fb6ace9b322c0952e05eaf76ad4391e7d6411d81be3e5295"
        "4868b81aa7066fbb166b3ad9a58df2fad854f3bce062428260962719c0918a1b6a599ae05dd79042d1ecaa36901c44e4880561aec91bc692ced9fe289821ed14501615515c338ee2"
        "b4563fa9529c8c802cf40190f20bba810fb02767a3c8928cd76cb4ef87145d3e3a7a169aec2a24ffea047be09caa14af18a4530815f1c58978d3be2743ed279e47ea314c51900b3e"
        "8314ee9ee49f32d64ee248a6833d1a29a9614a26d3cb6e47ecafabc64993c79b0661d179b3622ca323c3e3531ca38360075b18faf9e24ae610af8d7f746645cb1e8122fc041d9eb3"
        "6829f05b61af5b4f6bb9e33ea10cc3fcdd4787e6eb4f803826c90db68fad06fd5ba806f4a159b87944ab76efa32df5483e98015908eb9dea1b8c421e199122b8ee93ea04a3ec349a"
        "7b4f1993b95f9a45eac15ec79f9987dee1414222f7d8a0894eb0e4c77c52db0bf84f19e8e018f923b3f66d607683d6a7fee04845a78e551ca934f1f291488a7b43d3b573850c8dbe"
        "492f6178ea9b93173220e2626196e5d13b5551bc2f4aa18413e8f3ca2024e56e76845d3cb9f5727305460c83307acb55"
    ),
    "MPL-2.0": (
        "090ecf6bb357bb0f5f2684f2acd17e576f0c53e7377f21e8c36efce05e8626fc21085ec4fc67e27701cf8d5664010cbeedfcd6d1b414b788e3dff603eef5163c5f90c09f3619b263"
        "ff8df045b0923053ce24363c155ac3d39de914179387b9460639c0598cde3a8ee977e9e1d14a75cc0356bb814e8fb06cc78f584b7ce260d0350323e4bec714fb83624e7220868231"
        "ecc84e0678dfb72a5437a3a1038cd656a0ff5e097c941ae3ce81af66781a13927b67a946a0c2c719db90f03202da7774939cdfa2bec78ca667a4f2dd3495510f142036b1a55689af"
        "b5e78df333e24dad6bf316d2bf9bb532776f0366be84cf0e03bb2fea02e913a65fbb61a46b3eaeef510c890efd563f3cbe720b4ec4d3ef4d7330281da54318a9afd05aea14984b34"
        "e46fdc4cda8327b101e7754128d488358bd32a52774908344adba7ae86cbbd99d88682bc573f6dab2a2e9821ed145016f740951cfa83b4563fa9529c68df2acdbfbdf20bba810fb0"
        "f9ff946232a67cef742dc81ba5ef08ea42dae8b9a50e33ca0d9ddc131163e6ad25fe20b1b4c263fb3d3eeda6acf082f34a26d3cb6e477a0162519cb455d316f93b2487e6eb4f8038"
        "26c90db68fad7cf5c5157ed39fb2e39d6bd00494b47e726c199122b8ee93d6d2d783ffd59f4fddefacf4135dbd00dff4ec2a24ffea04cd4c346fd2701a7a63e264cf0515eae84c4c"
        "e0d40216283f4247f7d5cf2fa3ab9f96766b51b7100cccbcbf554c11da6b63af631e2725282bc581b0ba"
    ),
}
