"""SHA-256 of the canonical form of licence texts and of one-line notices that name a licence -> SPDX id.

Full texts come from the common licence files of a Linux distribution and from their published wording; notices from the
usual phrases with each licence's names."""

DIGESTS = {
    digest: name
    for name, digests in {
        "0BSD": "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c 9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153",
        "AGPL-3.0": "03d9307c71683ea521d0330ba311fef43bc001661b0882d8039729ef25f70d7a 0aa1709b95bc989c8f228539e58a41d59c782ac6aef6787229d2f4cb3f4d40b7 0b85335c2b573aec6836cc6b5e5866eb01593ac91ca2688be70129bc801a6b7e 0b964712564cd28f0ecceba2eae739e0f0195c7acf8ba4e6e1c8f24efec5b304 1229f75db9ac5cfced7ab4b9d87da84bcb2a31f711465615fbd51d45ccc89158 152c499f0675410aad006c54bb3e6b5c1a270c8af6718058ca504b002f130d41 16e7897593337b022be2858fa8d11f88497e773f0789b3cd7d0e4f13a38eed77 1d5a8de23887c7b5e853c6d559fc1842478fbb891072e3910d3e559ea19ebb47 1e287942b134ad4a2bc96ceed9e6b588d84e9bd5b8d7725eb4441acdefa8465d 1ff24a3fa27c2cdedd0c34aa34d9f651133775f90ec59d88add131ca36578fa5 273516d71121a47aed084daf81841d2e4c17d73e5a8ecd5e450ffec92ac17b69 286b49deba797df81dbef03d025cc7c2cc6a2ab4cf6f0da0237ab94ed62f0016 2c4ed3ce416455c2800071f24126f6fd503f71967d020b40aa9c265e6e4d4b1e 2fd58ad763bc07c777c00d20a1996fa2b87370dea2317490f9181c1516eb2579 318b9c88fa01f0edb66bde145055dfbe0b94b096cbcdca46b7cf04c885c8afbb 3f8559d775384914cae0da000f97542905726b01a74a4319e69576b2113510fb 40016a4d4e0da938df56be82638156df71fe1b2bb530d4b4844efd96cf281106 4474e2dd5b0b3545b0ce7d741b1d229f385a490d3a8b0d480ecfe55cd00a9bcc 4554f3cc9640ee311e955f0fa6e10819b5d549d511d7585285fe8ca3698a4b06 4873faaa130c2913c54b4fecaf7c2c4f67d6fadd59a8ebb94ab97a5ec9d4f723 49b61d86dc0f32bdffc4d2dd79adda12ef0657542032cedadc91700c2e2e4d92 4a2118d89fb5f5f4d80884ca786ff3637ca9032104d681436f8e11fd39faae5f 4d236b8b019175c3737b91f50944f3bcc99aba225e787d682f57d4f802a77855 569235d86a4c7a24324aaa774c20f4c33e16fae53f4b78c5fc5f82190c091097 5c33b07a2e3ab3faaf9a6740135ed5f58135476b50e0d6e0d08c543ebc1ead1d 5f2915061b9bb7891da12d07e6b69c1e0948cf06c046ab44bb93e8ebc6b49f7f 67eac53bc3cd76fbca3e53e5bc01581ba4e09c48af66dba5d568a200e0aa6c83 6a1ce048484d8e9d33694dd91e4bf111effbc66d417b3bda0f4fa344efd0caca 6d715d70131b8e855336d147866df22016dfc58eabf2ef740ee35e5ccca86da0 7884510a8bae64950a419bc36a4f77a243b89b9aff2b1f124498c48cbfcf1712 7c295927e42305c1f1628fbb9890ac8896793531b83d45595f2f54c8d2c773ca 8425092276f2d3b59ea3aaa87ef5289457a724159d71ffe7ef6dc3ad3b2ca76a 87b820bdb962081ad57c22b3d54ad57fbaacc1f7614b93642194aca2d045bc6f 914a58dc24385b9509139c1477b162c2448cfec39b238ce26a6d9c17cc6e3602 97ebb24d76f53a42aba080217d3f13bf7226e964fee00585f80a1295323f3ba8 9bd1df28152f78121dfa0ee1d1b629e7d82d5447332c9386a64a706248b23d77 add26b89bd09319dbfcc211f61711f1d49505cb1ecd249336b54f181bc1b11b3 c0b52b0f1962547d0a98fafcd9b3134508d96494515f2044cb5fe5d52f8e6358 ca875f388f7c5e934eed3d08aa09a578b98b638564c6b50d8472052c315809cd ce6162fb462dac3af3a9f41ba330f20afd9e193d4030147c64ee35a730a22a7e ce896e26e6128b70c428b235cd1bd09dfd563272fdb0c1c0296491f69939031c d210a13109c176ccb0a26e6e3b207f6ad3117d3072dd79426c6ca53cff9c1a39 d56ed3aabccdcebe925b99f535aa538619ab176d13cd4bc2a81c1f09e48d0bf9 d72196a2a3c13997c27264945d2b192825c581de123663b3f014a4d4a656d4c9 dfe1355a644d38bbb5fd2c43654d1abde727599e4290b485411901c77c4c032d e3180d1929318d6ff3cfe752efb8a481fd487f98b5a5ee12e7cac6e9bf8b1a30 e4b606a790242a82c7b9789be2da2275b4a0a9372093de64f88e9bce11da0960 eebe331ba9e71e1b1e84e6c26f6549378ca378575dc4ddf13e405438afd4a8e6 ef0350680c50baac13d2ec1a7eebe8ccb5ba37d4fb67383be97b178580bf1125 f7e9242d07ba84797baf4940b74f9036f84259463565a1554d2a5853308f3329 fea60196413cd8271b7c13c7c03db0b70de1659746409f64e9890863ad3ddd91",
        "Apache-2.0": "0312bd975dff7e2350a8875e02d421c811e2a00f690098a9e3f4bd52b092c20a 044a9dac6a06ae13309b2a009671027e000291421ba67ad6c5519b1d5ef31b87 051a04d76c8f6790c0029000279319474e31c2a16835e85cf7403ef2a4d02ea6 071399f5cac74cfea5b74b853c0db2809cf7376e13590616b38317edaec50231 0ade9accfa606b7b0c88548d7d30352d89598f361321dcdb7b7f1e09a77f1b4e 1138a97c474da89ae32d87775ff20351e4020b2ce4d2e77a366c3e32f9c8c0e9 129e61e2ce62aea4e623ea7239f42d6a1da06bac50042898abcf1b7915184fd5 12e5ed9ec4df580a58c23cc9f7e73b6565942331e9c21168c94a72f9411e6815 17a7866924aafc2a02b3a190ed34e8b783899d81a66f6923c6651894fa3ccc1f 17eb63bcc832596db298360221227131eff15b4d1324e95cca4a1517d2bd52d2 17f21927348c48d007e166a98a12201ec904b7bcf4cab833b3ecd96d8d633da9 1ad20b52e2abb85332560085ff376b3ba6eb66b83fa72fa01a092c223b2931ff 1eeb0cd6a418dc793a27061b17be61dbba3407cf36c633dfd509a0ba3cecffe0 2715bf8b4595b483c7ac6a1d46627336ce75da15633ca725b7cb607aa8f48740 289313b481c0f431115d4f17afc300a6007a10bd120bfcab16f02ea99128002c 28de6b6f31af692f3276f4c7d7f809bc7d39d3206a71fe090d61d943447aabc6 29fef9cedad89f36a25b5f58a81d9a83d14454a2c35c2722b006c490786797e6 2ce46e0451c1862836603e9c9b54be6c58727d5d639d04226de14526a512d4c6 2f1cdf9ceb6641ed14c49d6e7eba48e7b6e03d43e5152212dcedcabb0b93f779 30b5c3b7a09686824ded4828ee4a52bfe6e235b9770cfd4ad689522cb47f1021 390774546a086e5c4c436331c9743afa33876451b453102dc3580e44424a052e 391ab96fe7bb5305bb0d2dda4d6e15bf2bfe904ebfb0c9adfa687a2f080139ea 39f08831a8b50892b4de638466f26a8ee52264e83cc7042d63099429b154331f 3c2cc46eff71e1b2479400ded13d68686e55a7f7a376d3a3c2360dcab270dca9 416e398d5ae78452a8addfbe60dd960de8c68425d8f46ad37ef7f3b9035753f3 4172e584267e8ce8afb1328608e04872600cd5a2a00e96f7c480f28964336b00 440697f5d11240c96129ceb8a43dd0fe841fc57196343b87ded80f4853e6638c 44fdcc1d2c007ca37f36ad304896ca6ba5342d0170d9a82a9d8f6ed3e6c92f85 4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37 49d80ad7f18e6dc15342d93b27d410b6c49671f851e01050af20bf48af7b684f 4c5830e303b10e64cc40bca457447f0927c56156daf7c322cb48d8ab3d66ef5e 501f4b8e626f4edefd67c18f75fe841500d4c2fd4a8f7a5b4081dde03fcfce13 515d1c31f844f0a7f72a37b6cd34b5006b3cb9516ce1f0568bc7d34ea60528e2 53248c0c04e9a55474c44a2caf53f4063bfb4a163b9b135ab3ee8ed2eb7eda12 54df39d73f3aaeb0325a6996fea0308bb0ed1cda5d3e88684094de1cf11b0c49 55c1e41673cec717dde03acada500adda089bdcd2f875855ad19afeb0d1f1c34 6743962cdaff990957b01ddd530762fec30dfe543dce12aecf53eb2c6ffa343e 67dafd3c45c212e3fcb9c6bf65e64e1ef85278bfcdfba6b2d168b7198de93cca 6932c3c8d26067cd3b4696733a79757ccaec94390390f5c9cc39db4dc1f20f07 6b474aae4b8e81a34c167c93ffb1e61b180973b6b38e4f5b4b819fac1620483e 6c48e63f7919477b3f01c54f5b17268cc405321737e92d6e21994491d3adf81f 79fcf15dd0839303471961531ead5f34d8df3bf788417c03b7a8bbd179f9a531 7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7 7aeb946237bf537c9b18d52e2f83ccbac2e54f42dde7a67424c39f4f8b6f6b4e 8525d67e3e4f80063dcabe5ebb824ae9947e6c52cb0ba0d95121de2243e7f4e0 85df94981f2ec90a4425cc8d3222facc0c08b10bd2a584d3a976cbcefc7e7c9b 8e4ff0b88442a2b67fc201f9b3ea9f698a4d26f8f83468ead1f50e875acd2bf3 902ddb3614c8ed7c86955aeb233c5a01ea1d518e52509c601ce5ce4379f12d56 90590ff2ef1904e3e8174786138853727c3b39631b31d06e36e569aa5710f6ad 964c265cb9d4635a68b48551dd3b891f8efdb4bf62c576db07e15e4eec8c6dfd 9ce253150e80d3d2af4ecb54a81ffaeef07cd6bdc889ab311e2fbcf70db511b9 a0060c476205906c8b35eee3a29eee51a5c444c41d795bde2addf42d0ea64de5 a048231dd97c2b91e096c0d5c054cbd7660d96675bf32ea38a3f82d28a35405e a3b3fe910b1de7f8d5d4a72ebe6db0e71068e8d0bdcda677fbd03a1415c110b8 a6b06e2902ab0e7b49fb875461823592ff42fe5c3dd7224798e4191355ae89e0 ab313f82fc5bd9130fd7540cd227980c395e09b261daddfd416bcb5c4297a2c6 ae0d52505b98651b544af0feda124c44fa98db694859350e2872c883b775e0e6 b78df73c44dd0a6f7eceb078a0cd9bbef5b26b5c41a84cf180221d425484be45 b94dfa25bf189a089b1f5bafedfaec8ac50acdbf3aedae6fa0dafc82d6c746b9 b95a85d83721d192dd2e4d3d0f8da6f215f93c76f227a5435768b149cdad433d bae104773c9f4d1155cf9199fc44ef15621dd3a93c7f8c7d30687f8f0999cfa2 bec2715667506eb7b57095a6093aeee8639477f717774c67fabb478a096b8590 c039f523c8c0aabfd7403d5c7f99ace606399206ae53e68ef818236cd7b0c58d c9445a8f797e6cb4ff7dae6e82ae1f5b65c15f992ec3d3e5c3b1a029c494f5be cb1f331cd50636ac8af52efa1f5435b3c7b1008697411936d2eece8185dc786c cd97cbddcdc363376000276e26e90a9323d2a8d92c7bd14b46ac21c6b4ea0d31 d0cf1c3e64d6d9229074ddcb0703384a5ab0279cd7f0b7e85b6c2b1aa918333c d377b5bfdd5bf4ce19edc59758316fe678a710a8e60bffc47c2d6761cbbf8e9d d4a91e70b39acd30e06ce75b2fc5b21710e206c15438f59f080440637fbdce70 d51df763de1c3b7e4dc5ec90ce6aa99cf1aa2463941795117601793d1cb761d3 db86923bf866995802c9035b6255e3f512ddad7d41456568adcc45efcafb3640 dca592e6f5ed68de604bf906a741668ae7de7165dc8a56964b98affe1f84cc0d df423e7c4f730fc2a42bedd7382f794b4aae357d7b413dc5213e9a9fb3c2aee9 eff9e05c9de2ebaf67a47336fef7135676ea38a388048f3f843195d9ee4d2e77 f94f6a065bc2f0ca1b6fdbfae5bbfe0283c69b777ec4ce26f3206b2bcb570a5e",
        "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
        "BSD-2-Clause": "0767555a2f77264465e2d3daf21c2bacdc258becf3151df3ff26df36ad3a5bd6 14b4c19a7d9af831720a556376e5034285a008cead59ce241dd6bb4640e4b507 1a4ae7834f9770eddd4c6fbdd23f1c88a4260d75e0b3fa193e74ff2c8f2a86bd 1d7774e4be6b59f1c5fbc334d38c7db16aa24f53877828e964789d89afe6c9ef 1f6904a0f51d8f116db5a0791303a17ed979172c0e9d532865d9baf4107d62ab 21d3fdaa553cb021a79cc88d9726e9f77d44407aad6d6be2c2289d45412182f5 28f430282c2d775254313278191e9b648e8a7d9bc683def0b532718d69f5e5a6 2dd2dd8a3c6ff8cb819aaa98679b8f2e5f6ea7dcbbfa1914129adde478003b54 2f895dee7c99537cde5f5875eed6b6ee37c973dde0aeed1e69b4823bb3a39806 360b2080b04aba968c07fdf5c77119633baa5acc6a305de940aef0b39f8081b3 37c53d1c1674656f866ab8221d9ebca236275caa6068d41fc279345165ae3b5f 38fbf7f048a8c3aa324d877599cfe975e109f0ef7b70e2247a9c0315513226ef 4267bc0bac39cefa2d86a392b7e4501fe1c95a6c95b0f0fa3dff4ddbea206532 430d6424a558fd007633fee91194f20f0c1d0b7a346c7eaca0d42eee4474e552 447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2 4b4222d799be6bc7384904323299a13d4847c8b26b2a817e9dd350593a687e83 500afcd026615e8ce0fcb1cb866eb727345b52f12f782fce580e26a0071392c3 5a3e2462499476d9df2c54e07b4e52ea0e7c7732036e5d41e487b5c46a488138 5cceb2c0dede0c7d22c8e7dcbd03ed1ec6d286e7f54b4765083c689f36b0e463 63a8d44b0d50edba1ca97585321869a83e61fb46bcecc8b98f7f05ed4d09c760 6a23d96b0b11d20b627f92d805b73f913a24c02682707bd1b0ddb0233210e545 6e26285ce47819a69c5676df992362ff6726c6bb391902d663809bc4fc72af08 6ff79a5418e8962b26f9f5e4cf926655817d9bf541f5c5a28a04f8579b5c8247 7661c5d515f26ddd27cfc54c45abdd8cf45e330aeb2dfb56c2275abfd6da0977 788f560e1999e2279dd2ef6d7c1998a83ae49ca669d22fcdbf437883126ce381 7b475b9796df8afcca7cb38cee2756de242454ae22a80bf1779eadd6a1bff716 7f441e945d52639644fcc3d4b7e54179a6d5277b52e024dc86a61192841007e7 8244417517ce125a6a80ccc587a2ec3685e6a8b59fb2c4d568f13139a7ac077f 89ca91930ea55aff34ba4afee0eaa74b51a1b961b85435e5e171c210eeda6c49 a3985fd769ca821c592206b8587ef0a778471e1912c4da7dfb8b74ae7c0759ba a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30 a87fb4f6cb06d114586cc5e87b2229634ff6ae24b10fad1aa7d5c2b241086c84 abaab61dfcb77e8cb9567fabeb2078dad30d3a23ee9904c0e5ce9a3df98f41e6 adbb0fde6af6f700729d132efabd7d5a8673db803007a9f4a8fe11110a9e479e b1e8117c43b52653fd460002ab5cad1c4af4ebe09f3a1a3c91fe4f705a1dfa06 b2c1328bcc73c7e67ad0b2d74d8c7ad2802c596965f19917d5a63ec2fb5a8feb b6e0cef5db537470149abbc64b8e64455f369fa2b1244c89028cf9cfe66a8834 b7ae0085f29c11f0a13a61e28594165acf3413b55cd9149ddce181394eab6bc6 bdf69c8ef5d5e1a10dba6e44685060daa49963e2b3df6e185af34e6284c89c38 c3bcfbb6d8f66efab00d4674ccb070a95518f42e6a61c8e060a78dc5616bde84 c3dd99b98bda4b1c685b1e5d7d444a0337ad0b919fe41d21bd4d4036b0172cdb c468d3acdacd640b2a94b1669d1fcfb098ea9a173247935bbfaa7481cd73089c d44e9dcfdcd91cec872a67c33962c89532a66c3957b24d41d9ccb20489924b8d d60dc5d212139f7b7ae606a4db7c06d573031285245cdd995981e19c29de8bd4 ddedd56d2e12e4b318d0fa1ea06905c7538b4773ca5cb6956c7d3e0949b5a3a3 df35093108b1dad377f1a499eca7e4e1ba80b8de6706f8be52d79313f6ffdd82 e163f7f67f346cac4b68ce1d1b925a6effdd489d16c0eb2dd574b38e8325e522 e6300ceac02cb655c15e3a5c6bc653073c696abd391ece64dc301cfa63c43cf5 eca296fe00174e8baeaf66542a913a9d1a84b789fa0481d15e211672d291ec42 f13597651b6c3c6a3ee7090b9d21fe64490d9b4c8c16b6f7fcb602d3d026f12d fd3c40259d7a7a584f8fd50f97dc4fb173f078892600ef1740debf0990461089",
        "BSD-3-Clause": "016915e593ccb5578e6fb221a05b97260b921b99c37e20297a0a754544c3b781 035ea2ad62eadc94dd052ad29649d3804e62dd15c7604f52836df52d9d7b15b8 0974d0ab3b4deb9b6e21519293cacb68e85cd19414330602b34f54bba00cc156 0a3da30e7c439964059338cf631a7ca5318db70a0d82cd4bbe68144e75dc7688 0aa13accdea5db5d44c89ca1913898070f22ab631ad00cdb37141edc7365a443 0b1ab61f269de35590217729e94b034aa5e98f9f460da79078a3319300e68efb 1bc971e562abe5034fdbfb18c6fd9a8e32820ee97bc13e17747f24acdf771079 21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651 22ed2427c5119ff085643fef4ca5364a866d1b046a92dfea977f412e4c67d146 2dde165576e65cf603e271eea8b4a382f15cdc9da399584cf3fb71a42f2ccfcd 472344fe5f4c00f5a857185e996b760ae7115c49379eb66ebc222a4a7178c6bc 4af76f6b1905a1186b51e0941ebeff988b0a3e53ec61a8b9d91a93a67097e825 4b2928dd72293b788488b2ea066f4af49f769cd8ed6786d606c7712f790a39d2 4c94fb739dafa791d23c75abb9d2a28c296f068d8d26bc2b4928d092f57e1028 4ec3e2cbb46d9695a4b819ce4e7ec8a59e632a1773e08083a6b3be4d8f6fd3b6 5801666b5897fd015794ef19ef079ceb4ed427ea77d16b18bdf1dbd6ba2c0f6c 68957b1ab83aead90ef5782b965078144371adefade124eb8bcfda21b8f9c8c6 699cc2e7db3903080be3aea2ff9f0117ffbf9f5173732cf6f72df738a1a4c4bb 6dbebbfa2a29fd45211d8043745a913f4c4f791a1458d8b6edd3ad6324b99558 6eb2b7ff3f5c88ec0ee294a6ffa69ad5524b3e50c9599ed278774cc73bf15218 736bb95de6325aa8f4a4476291d215aed04b1cba59c563a6da75c2df660fabf1 73aa4850e2da2c1ad6b9e3b748933ac5f6d0d23c0d603371cb6ed9540997e2e4 741ab744d6dacf5361bf29fc9ad2dd81b71c4d71ceda9653bc8ee0925cf42d46 7dfff66592ba000bfd077e7a6166a9dfdd4a8c65feb52fca83a22106b49618bf 8829f191d3a3a5e547589a0c8122ac4ca3e536bbf5ceecccd960642ca791c4c1 8afaa9e91ca17e15d208be05be74db94a2c87ff8337ba1045c2a6d5063f68b75 8e547966dadaa33e939ae0bc2ff87395fefeab33e9c5e4d81df669f7f7cc5acf 9170e293183e20d89a030a54bf93436e5a5ad264b86462eeb2bcdd94fbc2b7e5 93e501d2ff520632df4572ac607536e7235ae2b8cd56749d7111516d70f6741f 943592cf7007a65710a4d22ce6948608526d6ceec18d5c863d5ff319c35c91ab 984625b152a899971f170a295a434b3b959be77b31cf7e6d433c5c88458ef6b7 9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2 9cf3e3b4398f10febbe86fc308f81cbdca74514282b46ff1dc782b7eb3d50d8e 9e2f07a0c82ff43482bff706cbc423cac4827e70a3c7f9a206ba9a83ea7f7cb8 a5d52a227dde9cad15b66dd2383708d087c2625e2316a45439ce8f824016216a a8e3e406cd8faf74bb0397244e9da5908b43d294eec30e9dd96a1e8fd4352259 ab49cf99529911a1a005e8f32167c7b1514296ad4f93dfebfebb49009430b777 b0dc3805359b0ee35b57354eae919085eca878933ed7d7543ed550e8215f8eb6 b97f2aa329bbb647bf25016e2835e465dafac048e75394390ba0cac69416b184 be21bc8a6ef63e5c5e0dfb1b9394855d2bab20c54b5a2fdbf82b3a4e1550053a c31eefe033822132c2b5df919099c1384750a5d3354913e7396ee728cd8b7d6d c390f8dce954ea7cc20364b1ad5cdd122731db1b622fa874ed464c2cca7bd35f cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15 d07286e62337a82b28f4f52dbaab58a615f47abba06dabc4038017a4c5286706 d28968932162b8433ef644845af54683048c707c041b34181b10d92f447d2a9c de8f095f8696dcfecdc8242f96d931373e13a7266ed84d03609fd63e13dfb1a1 e823a4e50437859738c8c7f90c80200df125c8a9f0cd6d037e17acc1246ed800 ebd97e69923e8355bf47d2fd285de77ae561ee5a64c455abeea035f8500f21cb ed2d7e537aeda44f6dead98f46c9f7aeceb5e492873803fccaf552e02ad0df15 edcc4f4417a26a1be4ea8e043735284492409d81b5a76d8ae29aa225bc0d8216 ee52641ad306a9408b0928d682ddf4f6e846275a3491fb01c79e2f7d37aa7829 f85ad7be78c13f1d0320d396b9dae7a6aff975a6ff730f3f628d4654f4bfbd0a",
        "BSL-1.0": "20b25b3daa7b56cfb09857dffe7238597cc43c87fc6f3341c83245ef1318738f 32d9f531664ce2dbb213265ae5509527327c6548f23425dc10f75ba904a67e74 3fbf9475afb4d94a24122608c960368cd4d1ccd7d15dd6c791d23236692cf95d 3fc8f145675247f7a8b5ab9f77e3040a9b0cab72c1dedc53fbfa3e34a5513912 48ca63c3e47fb229b7a3048f8da4e200c1789eb38acd6df787157b60fc1fbce5 4fae986e76286a8400cc6883c08527a155155c5e6a1cb83b73f4db5a6c96a6e4 57502f0311787ac98b276dccd109af3ec5733994696b72317a7e48dcb9a8ad72 620a7fbdf70607ab4be5bdfc875cdfcb6e4421c625aa3f084526bf2d8576c3b5 71db1ea90e0180da37df789fa5644e32bc130cbf89f454825eff9a4fe185e7ec 809e0d5d9c1e45b3bffd9896e4bb37f04f9dde565890c58c10ad6bc3ae4741c6 844854a0c54055d9bc76a54e3c122b9da7239a0857400be278888cdea02a0e74 85b12dfe8d496fb713e0220df553c79103ea00a98421b1555a4e54690e40a24e 8d41165580628dbfdb009e07b12ae8d039e6445505b3ddac310224935b8cca9a 9708e81eb09d0bea6d98c8c535428f062e1bc605c897b4c3d0ba89f8ac77cc04 9ef9b9baaac87ae0df349637c1a1229dd8a469d84742c9d43ec35da624897d48 a1c2fb2f8a13055ec8e18df3fd2bf1333f3765c5008362d3515c2c81ee642122 a4968f4221f2c9aa642027acf125471141bf3037d64c6d6317556c668c284dd7 ae28456df9667061e336420f1d10defb0f8a45933095116825cfbf1e3a387f57 ba411d560418eec8d155b1bf59e53734f541d08e6280665a063063c2cc712183 bca45a902c4f3bb721c8879d98b34b44326ca4aa26ac7d4e95ea44e2bb4c5819 cbcc9840fe9f0cb48aa3b5f97a7698b972f83568d9576a7bc1554a992aa581fd e40cc119b45edca6d1252ba1c218541bb332b9ac2de35dc1eed33e01c9eeee88 e9e97701dd304d2d48d61592a12b8e035af9cf1f4e54c18473ca3248f44a0e79 f4187458bd0e9605de5e5b5e4154513c0685b9349d33f64e1b5028b188e621e1 feca915437591926036486722f50adf7a2093145ddd270a0254f4f3c0498297b",
        "BSL-1.0-notice": "e0eb0a37e27cbe7980db150dea98642ef22985876c2727f4fb2059bdf550b194",
        "CC-BY-3.0": "038f4add0a31b89997ecd9cee4bd9846948f43ba4ce798c89f5d8a88d50858c5 06ac604c41e4a2817062b55de8c0e0ba277411de1aceab29edaacff15a94333f 0759238b3024f3077ac053731bd9b531f7dba7e65583f46bb5c131aa57ae61ee 0762eb90696a2c8d21841d0aaade9f67d2570f05feb3a34eff4258245964ee73 0aba527487603344ec061eebcb969c7876504cc12c7a67bf246ec494f58ffd06 13035a1cbaa39bc8181b1bbea116f313400303e4bfcacbf64f2be3f076bac94f 143344b5a626aba6fdb7bdcbe60a459142fcd1f99f2e562c26eed2b064ea17a9 19b97953a40cf145fff06ae462cebc52e3bd8c9705fbfc2d8e30943f31e8260b 19ded8db482d942ade54ced00f3f461816bda7b55e21cd634d571f218d444d3b 1bc9535f96cba9655230b495bf322620c4e1e252f53af0a3560a2c48790f7d14 1df4daabea29c07c9ed690e7ca995740fded1e7048820989efa96442b64eb63d 1e956e8e75d5ef32591c9b596b43d902c7916f4306dc6cc844fba61d4048cd0e 2292e451e75a59dc93757ceceff887c5070069b00f0de3209ffe118c389f4800 2899ad973e7ad690fb37b1d904647fd7675ae5f7b3548cca8e3905dd6221c2b0 2a60b95e4fb0f95b1278876e1c401666f6081ef1014b1304d7b346c15e7f6041 2c73f73bf5c6aaa0a3362c5bc0a5c04b1cabf4eba0eda9f69f872cf75f2b9dd2 3027dbb75c21300205a52a0da9e75056bad657cb6f2a097be5ed012a1492c53f 32eaea1bd41b3d73c9d233949d8dc99b1355f38b9972a0640a6451870d8c1edf 35dac15ffe2cdb12c910410af86fbc606d5f0fd9bc4df324c566b4bddafb379b 442b2a93a2be144a9d7c8d8fca1985f4eceee3fcf92d06dbd0dcdc95a368ad60 48f57cac032e135cdf80160eb231be592aff9f3548d4facfa8556683a7abde27 4a2278b9d6143121253b3fd0ac2657bcc9bce182241aa5ad9ba5d79c79943392 4c7bc2005ce396a22b2247cdeaab02e9edf371b7c2bc5061b2825f0d01c35e20 4c85be2a17025f2dbb881b768f6012bd2753ab0f58a3a072c2c8f00227d77cdd 4d7215cb3652f5bb953f3871d8a37c5762c087fc2e91bd0cc37107bc3fe852cf 4fdecf320865f6cf75d2c098a6835f44aaaed815febeea2197bba62c2b716c8e 530abb27cd726907463ad44f77dc29f37d57f7cb9b531c0cc459bc2715e38b27 56189ccbb9be7ccd99d37f994711c4996244b87f14d496f5c52a54ac89ba037d 625b275f42a735d59fe723747e802753bc3bc6a68f93d61f3d223c837641d146 6a4aefd61c4a708d4e43bd59bbc9a4962debe7854a062fdd3a4fac4c52b433e5 709230e16a77f4fe9ceb9c31a51b8e7e8952dc7d264b5cd55e547773c7797bf2 732586e5bb36fb2f60f34a7c01d688174b1262c417d880bed6f9bfa76ff2a71d 764a9388d6107093e91035f01ead8f404079d9114196053731ed5c144ecf8d8a 76c1194fd009c8593936b7dfeb91c5ff7fd898d22e362cf08c15d91b3b6dc51f 78e03b6ec3cd311221b1cf4eff5ae77328f82f1aca6f793ef42038fbbd52ac85 796c31d545c60a3fb7ce5744a3c5663d580e0930445e2bab96c92803ba12125b 7a874dc61fcc119da73bffcfa2bef661a7b3bf19889b4d86cc38582d2d0fb175 7c1a0c8c6da5e55c4557629b95d2f8028033f9fd910a2d1c8933a8a87bfac86c 7e1d7bfe2f8fd0c14662a985a1d807d66c381d4357b5354737e1e01fd4435a0d 7e6c055f1dda1736e11a013fa1bb4a250c9d1b0e0bcfda464ca5fc05432d8576 7ff1cdd75340d8407b9b21dc5af71d589bad2957fe3fcde7be580dae7b61d034 89e7f2188bcc2cc086513254d1627d7e0bebdbbfd16ffe5094d68aa9ee29caeb 90452698938a409b7be271c052a2b84831f0c1411db9273a32eade2e7e0a9934 92ecb8362a19a3c4e78cf232714f0deb365f863dcff1e883adaa41ed40ed8e87 977f2c09e200d1a9de3999d94ac1be0bc3668d6b1f924926d182964c321de0e2 9bc722da68ba40df235615751ec992215ba78d811acdb729e017a58778f7bb1a 9e93ec5b4abd9c1dc1257adcc78df20ba52e974a2083ac3251ed21d0552e968a a007cd212f99eb4b54804cfc58a72d11a1cde52c56aa0739ff5a1c96e0ea1363 a09ac08e2cf97d69a3ef474fbe9c9f5e6ac6e1b2fcab11e5834fc60d3f14c509 a3ed57ad86b404d279697e681d2935d21ca6d706fbc9286110d467bfceaae1d0 a72cb94d7108d6ab53ce39eb38938cc9a138d75b3e46dadb2e1a77cdde5b06bc a9c1636ec46a2a389e597dbe9a4558050831f1ff233f2b6031efe4e6df695e7f ab112c35f198eba8f40c6d45a4880d469178f832fe8830bc39a7fbea6d39be06 ac349ef4762db8e23f296df89f9bfe417cc1fc3a3218da19950bb0e52fe13f9b ae8ae96006756532795b43dfbc7beb0cc381e05fc8ba3ebf0522cbbb58437c44 b02f2ce9aba876fc57e6e88f4f5e9ca6c537a64e0445adcb987fb92b9525ac8a bc2e7888f091e82cbf26d332c4a9060f2092c438d4792ab4d6131d9b87a55333 cd6e49eb68de938b33a6a6e4b3da81c58da27b3b7ffd944ac5b7e20c63289101 cda7628e87994701d27af3a11d9937210be71850e24e432f73acd53d77687808 cde91c9b866cf8dee3a2ff0030ace6ff3ff582071d377f799b6d903de8f52699 d086b6d676bc17e2c76a076d2522e609728fc5775f94d997fb1fa702be50b4f2 d27ea140c5a7e59f53efa3036abfdad92ad868a9d3dfa8f7350fd181bd6fdafc d899f952fc6ff572a3a32eb9e0ea5c30fb0c380fdb7a11166d6fed5bda884bfd da39bdce178805785018d128c7e79ddc14993361bd8166ae257ea4ca5cf6df92 da7875638d15c696f5285547c920aa701bacfca59751d5e7886eed4c01442e8e dc2ec513f01d44a2d77f6ccc6d0403914b43b89a9fc167a495e2437c7da05303 dcbc6acd536ca6e0e2c1a536b499cdf2e8f8424208a3f81cf518bfc581b16c5d df99510d5768181106ad575045746e03a4781c84a23fd465617e239a5a796710 eef240947307a0022e593c6e93c0dfc532ab0e4b7d3c523b87fb0524c60567b0 f443936c3562d3bd175b844eac1fb570ded2eb587a2a8d82624f4b5f9bb31ab4 f479d10dd1f679b232dd0848789d5e79f2da659154a981664c490c6491d5d666 fb61f7239fa5f695d36a777b8aea2f7812b1c4bbd7abc6713c6ac035a97be71b fd7b71850de9f2b81b5dbdf64cfaa0985a97f71eb748c195142d579fa9403884",
        "CC-BY-4.0": "00defbb6b15aa698715e064444d0b8a826229908532570f60499c5b84b1da1e4 02b5a822ab644abbe70283b38411cb1ff71a05df2e390d1c36b1d13f6f582da4 06787ba2612b9230e1e10d42a15e6f8e0ac612ac18274fa1298d41fb0e05aa4c 09f354ccfb6afc539fc130fcf89c1db364578aaa85d520946b8a54c4e917d8de 0ef7d2af1a638c1c5f1e03cc5ae906475cde770b3a094ed68f83440233303555 13969730064befd993fef575d9d66dacf446c7251c21dd430fc0d5aba31f3f39 151f1be9462bc7183716c7fe4e432ffa2292ebc7e2358b6410552da808ac5f42 1521ca60b84f4898731e6e0b8cbff5537e9c5e9ec2d6183cdc354ede0a1030d7 1a2b45ec2296db60c5ec08ee394304e5497f1816e648032261dd421f009de3a9 1b02c9240bb2275f6687e4509bdc2c9340ddddea14adef4e0f1b284438ce089f 203ecd11a7edefa293cb9d896cf16bf28dcf8d38f2c3505a85f2485743eb9c9b 25db7b151bf8cb3e438aa8f5c5487f8d07cfbb4aae8321a58baebeedf6b08c7f 28ab122e72fe3ddf0a7116e07940a045f5df301345d0a69ce2ae15cde7c11c8e 2924c3c587f39e4db080c9a8e9bc500bc4e8267b509d6ecf107915758c4d3cf4 2c8f6b7e3b30bb7748c9a8dc7fbcbe737cfcb77d9a836c18f933b6ddf69dac96 2ecc39d8549638ddc9daf8f879bbb9cc0a160a93a6e29bec0f48f46a29be1b63 34d7773915f08aaab99d19d65872db45ec3740e1bd1704ee422b55ded36b27ec 398171320dc3847aa7846cd872f1ba599b346e5d58a0c2625b57c0ece700647f 3b8fab3911ebb6c44af0dc74eb9b61a55e76f15a69fdeba891a997639d84e2ba 4002172d88d1b8ac1f4d39ad0288cc0130607622b1a1151944318a0a167caf28 52017d43da1fea52f9420263ea5a0cecced344093563c549283666dc18b32ccb 52d4141a1d26b6fff4836b2f3004659d9d9577ba87cf2e266ffe2bb9204982be 5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2 5cb6562e150297c68041403a11fdf6d944dfa52541fcd977ddbbacb51b0ff17a 5e613568bdb300b6618b5a44b1ef419159b8791857e3c3b343d6b090fb7f2698 5eda823210cb907a51217f2fdc600d2a54a328d3e84f1a49c9974dd09cb5ffa4 60ec122e23c713e5525f3f76d2022b99947cf46595bb1d0b971cf526b343196b 65e54fcdb41884818e4a250888537cf36d844776cffa6d3d750c1c00ab50f74e 6a74174c5fc1b62a70d325e6f925a7e229c89784eb05d17740de9444a658f010 6d9a1b9665c9177983824c4c7c522b8fdd62f4d679c15949e99571d58370aaa0 6fcbe5594e9bb9a3a01205a9ebb292937c2bcc5659f83fc1d7b4519fc60cc459 70f3ec245a575f736fee97cc3b7a394681c8c8a8f94d1ea9ad28c97620561f0a 7271c40ddbc70c5e44d792e8ac791d797449aa2da4a51437f0c7458e642149c0 786e709346ca3b579f66dff051d6c3247a5050b92ffb4228de9eeb16adb916d0 7e86a2b6a748e82873e0227e22bc5c0d077ba2c19cf1f0bf8d21f3a3b14aa8c6 7ec2333790e475c0273c552bcb35ff2dda2be0cbfe0808a29482c8459bd7f671 7f05cd67f36ffe7ac42afbc6c767ee55ded8379990895899bbf132680fb2126d 804668b9ff2e000cd488df4fd969dc3fd67d52490f3c93b85a8213f989032d6f 805ccdf5b19c020f94bc3c8022051112a7644cf0926e871c58ead3407cf17013 822b4d7dc3e32a24b1fc5c804d140bfe5d91eef8d5592b026d54843ffd09c895 861f77c73274029abe33f8fb941c12f6583cacb5be6854b81a7b0ff6589be191 88203233e10a05b5bdfcc695b12aced50ef62e5cfc332ed3b4a214f7c1728d40 8a5cd5243f1b28558094b1071e3b48401d0c6ea097f0477047b7a0a76539cf47 8b32c169421f5f36341e8408467b18d1079ecd266e1989dbc53fd3726fbdde20 8e695f51b37758f01f15e4863646b8028b4306b7f2167cf725fdf1a1c4aa9f94 8ec824b6650e7f20ea7d49b8cb037a23450dbae07b2121052588826d3a0fa388 972037f15a2ef5f69577ca4bb0e3885f7f9eddcf528226c1cc2d287d6068a754 9b004b87e260e653a0d2632eab840c03f98958ab62cd64293e5bb6c880a16b4c a072962b9d541b45fd07e687d24deb2cdedac872ba88b7adcd01dd7f7aeea6b2 a6e4baeb63c803af0794d28a0a90f26cbc18daad405d347e1d3d6e8dc63049b6 a6f478c88433f71ea2f5ad68c4d6dcb536b5c1d0d29bbd5902956cec860c0a7d a94b41ea6370c19580e7b5b0e650ec4c88516e618b88210ca951aa47ba3bdab7 a991907b50ac55706019cb7a19d742fbf1b08c537fdf4e1f7795406aa96305c5 abe1f24477407f7523e4a2570805297d0205a021757a6c77244c59c74000a02d b3d7e823d59cd14f0dfa4f2687204ea4e4d1cb5137d7bc93f928aea0ccebeab3 c0e3d85d111cc5871e744c0d15c90571a8b5e812160308b39bccea35fea5e65d c1386e93386f3b074877fcda7075d9282a0e5971b3b854ff73c488e04deab6cc c87915f49834bc0aa9c21cf97e080cbddbaf23df531dd8f69d91029be586de03 cb470042daf825ee54721fe4a65a0437a07ed59ed8ab84c65c3da6f28189d621 ccc0fcb9e02c3a2f82249159fd5ede6ba12c0111284a0de229c7b4d0d4cbc312 d0064b1b4b192e95c5aa4de776e7334b5a7a41d0708277a1fa1a1493f8384c54 d1789f9984ff45433687c90187651d350b8e1acb6fbb9e21123be6e771147224 d1af4d7eebb2870ad885df26fa23a60a82f9cffc16a08981a503ba67464a3092 d1b6ac518afb2ac258726b75e7035490252693a1872655a5eb4a7b1081f4e938 d3387945d27ca2b098eb49aee10a995d373e0d533dd5e7c3617ecc42f8de2a22 e8d5210644b1b3c7f3f76e185e7092e4eb80f368cb851582e68bba48e2bbf12e eaa2e74e79c875e227a16a33f4333c6135ab008b8ac1098148e885d6fbe36ab6 ef9a6ed2ce6d34aa7d1e971bb89816bbf5cfb1a4a1f5878ee3a08c2e4f17afd9 f4768699d280685978e8faa4f40eb2f29d4651477ec3ed018cdfc9f0777f7101 f636ccaa2f95def0fb6c3a4396be6f3977d05def7ce7d77813f5a85c00e239db fb3bb9beec732ec0f9358e197b368fc4e2b74bb87a6d1d4f103dcfcc5e96ee8f fdbfbff6fd22ea50f67a582e3c8bd4b2d4985ddfa25ed02ade596218af043307 fffff1ec40a5ff066ae76e6024486547a7b40452a2e32489496d51691793af8b",
        "CC-BY-NC-3.0": "007800b63348c92c3eb5d94dd718a0f6ef86eec2bd8acf947e3170f5aa7573e7 007d12b0c31d07a6d8494ee9662ebe6615e98937cec2834e68b89a8036e96521 014772d17fadf219fb3fc9d4ed3ab91ba6b14a199246c18af16f53a632077a31 03a17333ff48c2d6beb1987660327a1030cbbfefdd2bec233455a7072bd93163 142243cf4a288a81b12a7e59b3dd7ad847f14387ed673d070375c8a4dbf7c393 1531409836581a199fc98164d38f3880f1f17cda0a197a3fb50bc69595e92f35 19309b834bf058b61c7c6dc6f20d9c26652d433f6d7da31727918a3a14b68fb1 1b72ce9bb225c3d62aec93204037d97e100ce7c94f0adb54c2b19a14f8edf0ea 1ca736f131bf9ad2aa4d4c75fad751b78e864f5d6e736082a0bf14bde70e9a60 1e89f5fab6cd5de80a6e506c0a41d133e8fde8972e267908d556b9bac4c719c3 20b327391009980c180b3d2a182796509a4f1c05d7e21f6ea88b9d976794a9bc 22380f93372d0df50244f7b415401f5f89f7e5daff728e95445f60f9bdf859fa 257d31468f1f555aa0e245945707072eec26f1ca266f4b6acaadb9fd65048507 27eab559e7fc82f3b4b312c9f7f74357b73f78225e828c5997a5e6ee083ce3fd 2a2b74772e928c1e6bfe5b1698b3c02036655cc03772b24fd030c35740ef817c 2d18bc6677140237184c05c46dbf832c173b8703a6506e3939fdb9e066e7178b 2d6612d6d0f5ba0ac38a8c9596b9f4c485f8e5d432e7e389fd0095f0203f5251 31e172ff0c1718b3f125dfd9ebc2a037bca6bf4666879fca37fddf34cf3ef717 36e45757461aae9775b50576403d406cf59dbb817266ba3e21cfc4b961fe0a49 3bf585014aacd2bc6f32de0e5581d2b22e2708f08488fa8af5a92b84ead0cb00 41999a5749cf87e5ad7abf8efcce96a33041e75627d343d45b447d8863ae2a17 4cf575577ba51e3854061c7ecc47d503807709719fc58976e5c31ac401a20f16 4d8bc7f3e4ba2f417dbe800a883b193072deac0b942186f54de8cb865dedb31e 4e25f43525429a3e9db4f57530fe889105eb333a4e13bc6b321956ef24882e20 5180422386a885645483bda7235662bcf55dfd34e94d6791fbdc92eeddc20d54 51b312b9de7340056f5d3c1d9a355add3b73ba510318d199c0fbd50257b8dd2e 58a0abb9f11726e6dd3c8a429cf32ae7850384061494c76e8b4262630f13b902 5f7145c0a10f13b91e378cb1454b1fa3146a110c6f74bd5c95fd3f807c3baa2c 61ecf52db5b904cb0fb4652ef9a70fc29c9796908b7ee8f252d28bd5e0ed9b56 62e863a474b8f26e19af6237ac84d23441c0d3543d99410c79c6454cd359acc0 6580faf2f04e0838e28d9999fa923b1ff267f8e868b5a07d69ebf670966c6a56 662468b47789712f1364e512fa20cc8882608859b8871af6cf7e9ea5d852c55d 67fec10789c7e7dddb44e01009bd7222c52a3bd6365c08300b9b9ccd7772a535 6d3b5b7e4e1d738e121ac6f83be25a5634bf817b1e034cf11c47a40a29557e35 6e575e610cc0e58384fb70493089d61c8cbb6e0421c9baa46f2f1f878684ad5b 7419f230db1fd80009e5f28932f0427bd0f6872bce46bd86db136fdc729580ec 76c17f76ada7b06fc8955a4b18dd5f1ba75b13d84645161d20ad0e81f854b4be 786e6de034ed47fa8515306eb455af01a5ef8dad61a9c4338f921136fd8a0176 7deab682164f6c58c29989e1d2f525832018f6983786924b2ff0b11a3d4afa2c 7e8cf9d46f04cd506e3a0fce94d769339d906e0763b9008a6b2bd17ac1f833e6 7ee7edac851903d3d486bc47117749d36aa244f5beec21bc87f44e96f6e4ed10 82d70d96a33ef156c0870c6d116211e127386391b9523de65dce1e0ecb0d5d8c 85b87853cc8c4b6b71dbd181e55cc4f774a5be10ec69b7586f9411ee838e9d77 88779551582f64e18793d2af51899b1c1b9c1772ffb179e18ae5195ebcc4bbcd 8c72cedbcc2155c828dd9142bac9e71b0c433fdf594b9ad827896101937e9ca3 955e81fed014a24e2fc348ed5d80cc7ca32041ecf4628581c8c8558d6b644568 9b507f5800d2b3f8546be03d4ef9b5ad765b2e06894cd91fdcb67b20c3cfa434 9ec79394013024c0fee0c55de9664f7961241ad25f3f6533e1621bcd4c0a69e8 a6e2a122eed739310819d8b9b5a8000dd4d09f45ed8b04e95fa0ddbf8034d0f2 a729e9a2dbed4c862d0ce7c4bb37dce8d85c15530d8d128ad09edad2d47b2a1a a7945466eb87b37f504d1bfd3b258a10e5623cc5e79b170a6ac11c09e2e9163b aa655bfabad733884e56b204d63ae306f65a096367a0efb2afd2daee276c5f1a ab538246a8f68ce6d0cad52feeb2b93b5e11fcb41656eb6f803f2cfbd8caee10 adec68699e6ec1917bb8cf7ab7d201e7fd8d37bc8ce58001ac77018ba5af3749 b51a3d095ccbd0b9b86bc9cc3fe4a874e8f314c2ab1ffc9cc6a236a9123866ea b65462ae1ffffd643da388b11ee31796b9f6adb2708e97fdb1f617ec1d43fb17 b8e38c6f8f49a266a4e52406f309cb6e535120441688129d0c109760c7abae9f bac5211d7a93a3cd7f4b0810baf45da7716db300011a02d55d1ed0af97da7a66 bee9d1e3d98b48542f53fdb9798f727653c3a561b7a574dcd196edf6bf9329e1 c0ef8f035b5b7f5d1032023831b1ac5a85983a1fb33edda407b8a5c943dccbf4 c596f2951954e8114dd3d151bab31875cd7f7658f73f8d553727d89bc3d58ff6 cb220003bfe83aa83a548feab3b4b7a0b57fdd43a74417f4d4b983abc1c1c792 d027ba5ddec0213eea6423b4a147cb92d862f0fba4f011dfcb667f0dbbe7f97f d262b651e90a50453a6a4b5f9325c72311bd58953b6f828050b0a1f1e0d71f72 d27fdb413f6fcabe353a2033241419e6a88aab90f9c94c9c173e0bb43ecc140b d96ba010c6242007b17c7a15f81148d31fb4ed3c72f9c84526635f56faed5e83 dd115bc8b8868f706f6c11a01ba906cefef9ceef8d6e0299d05a81f6d4da29e0 e1f0506c0ed8d497e2140fb1bbe27f54f22561ddc22fd9599b187337a07f0179 e30401d6b136b0ab1c75253e121a139b78a4ebe356db110487965ce52f80e0ba e3d1367ec15328c0030cd52dcc8d8f4f0dedc60949b613aff625baa1efc77286 e549f80f173acb4742b34427d72268da1b8ae52f4f04cbd0c1e1818ba2870c75 ea0241ebe492a08f81d22194f5fcbd8699181a8af75a932fa216f12eada639ae eda04606f984c68810917d380e048d299d00287dcdcdf6658a4dea69360736d4",
        "CC-BY-NC-4.0": "024357f10e7575cceaa81c9b2368038ddef4e0f9c1290a18eabf5794bbaa4f26 11e6164228193f0d099d73d367b7529c64701f82636688fee03f5970b49199f8 13fe954bb47daff6dde37a0c35597fba9ae75cbe55f90ab474791aaddca9126c 146b55c22b11cd040f64a25eef0d1e9be4722fd648dc07b08db197e5db640727 1962e0a4073d9c53fda549773261aad7ccbada3e1086b562a1f83b56a142ce08 23c710c05618e51c5bc82aa440b62e888beedccfcf70261b0c8283dd01cd262f 26ade00fad2f5b7cdf5ec4929deb2db184b9be82a2571ad66810df17f5ee9384 2b50504e3d47a7282e5d16601cff129b2d0f170207a8fb6b0f8bee9d2eccf41f 2e78ab9360304d5b2e1045aaecbdf5dc97ed56a2fd8039ed720a49e4ac15bfdb 37899348e7716f68694e7221600cea77fdee2c54c9c5802ca4a7468ad71baa90 3b64cd2f31af5791bcf3804889cd1f0066d38867063862debe052820f138abb3 406974939a062410031669b9cc7b06383ea47645f150e5c15c728a217ed97543 437f9bd02b789e48253d8507b6eb1ff6d9f7958318d3a3d263db036d7a9b63b7 4645b77adaa0f0ee8b9fc20489665928f61fb8df820535a8155022376fb73d04 495a41bd2b842e9c540d7582be94171998882e40162ee0538c122c9839838ea8 4bdf240b1d99a344cd25ff1c64549f8044725d3889803b300026102ed24d232a 4cde8e326023af77ee4c0178e8c1252b715aa212534987b4d35c0fda4f1da4ae 4d14111c2404794ef0d192e34395f1f9f173c4536ea267702a8a71163eb406bd 4fd980d0055b56c799357b8f584273f86ca63f9314e04be3432f36a67923d028 563d65a2c2896a1491a105b66d6c77fa71a50cf7dbd83a138c69ba20ef47ceda 582dfd8bb11a624fa7233d1bf83b235b238e2237a0ee33923f7db9c94fed731a 588ef53673fd1385b3dda8334d46c1a9a6d97fb3873a20fd93cb5b813b6d5c6c 5e7184629f10d31591fd48d6cd3adab0e28d705b3f2839d212f7a810f349a8d7 67e3a126acbb95f9a81900215d13e65ec7cbcb1bd93a1c8a47b60abb1aab62e1 69082459be004339197e6c0f0a46ca1899dae0bcc5314e10cc8f93528039dcf6 6b54e7407c8d515c8cb7062b75a21268e5d5230b9a25557969ba6c0ae383f1e7 70ed15302cc08d8b199ed3aaba3a394fa2f43e386658ae2b21f9d30867fdad7a 727962fc873cd18d66d6ec979df185f84a49cbef86c9eb59808f9380aa5f8776 7418cb22c0fa6884e6fd43cdaef878e5b87032372bac52385d40a390962282a0 7443c96a41531ecaf70f726e8e773289bc35a72c8d7a6facac89e4bf244caadc 764fd9041f8854fec23893333567c2877f408d020557362cc73395516d85f96b 7706f177026ce9fc57f248e96add3e852487c25c206833656ee04fbf42242038 789a41aff65f98d47654f96c573dff21e9ec4b31e5aed554db3b4543380af5a3 7ec2d95d0d28fc1ea2c384212a8248a7a21e1ce1f368b30cac61a067feb4025f 800daba0915ea22e2226bb9859bb6317aa731bc90e7ba5631df0e27e549f91fc 832ff4da3bbd13e16c7a773536262c9c6462b635f85c002ee3e76b703245378c 8600a43f20ba3f951dbcd83bc7759af1c71cf5d531343acc2a36051db46b7289 86ef52f6864229e1e293c2ecbe9d0a0e6c2f82a13fd425e1c13449c72732283d 8b2465544b5a10b5814cfb371bf02dce2562404c80e4200a7080811f6839bd8d 8f8f5a4a54338383f02f819eab1b79f8634190f0beb90ae0c67e99ebbfc5bab8 9325af8829de643896537bc192e028ad5b5311e160f4434381c3d24a6f5ea307 9a2512b61a0c73315b8127632fdabd6cdb3a0a9d787c0cdace086ca0da895e16 9ca49863e0756958d45affdcbcd4cde6a412a13fcccad99cf2e41259ef5df834 9db96ca6ebb5bca1fc3316601f020a1f798253f6d59e95486d130a081e4610ae 9f6219a2802c55fc8e84790889c89903deea1db4e3fefacf5953ec4b6dd76b0d a3099d28719ba8ac7a94feea3020ca50f78b9cdcd052dc3e02451d43d3dc771a a8cf3e325def317854c2397295c8ec1f9b097ecfb7ea781dc85f1539908d965b ab6a9df42072e54db42004e3f72d84b7a309d65f1fa89e3c57bd6cd2aa4bf7fd acc91447031fdf43547af384349e8e0fce189fb04d70f36b0324ec9a2fba46f8 af5b30940bf4eaea25f4d320ffa45256ea2a81d8a216e3b35af617e06d84c59b b304a1229aade3004780157e60774249efe9dc7e4c9920d8433c0f37e6680148 b80c95e1ea9e880f0db53dc8e2bc4f599c9acef58d3b9a9b7c823e6a330a5cc6 bc0e58feeb75234fe658c1367793bebbf8bca0b5017f0d805836a9e2c33b606e be5fa88ca85b412bdc4201ac32096d9964bfdc09c4b801aae7c5113ed41f08a7 c1bc58da08680823fc59a76ed67ed7a1fd93e10486d316b2ece73847df734f27 c379fcc4d26a8698aca506bad24efc5e6ac50452d12a8f2c96de7fb84a355564 c7af20eeb7305c41f4b610126e0ac275be027ac39d96ab015c61c3e6d0658636 c9e58d7d0aabd3e50b9bbab579d6414d322cbaca9d6b7aa9a77b29e61d165cba ce5df143207f60b1557b741057dec492c175aae7b06bbfb83b9374f5f3a43c69 d23ed1fcaa32ec9fca44ab6af0f1154ed811841485a9a5f0cdee0f5df69b85fb d4cfab83777078623a0e5c56872915fda5f2a1a5decf49df38e92fdb37df9608 d524e3217f6bc24b457a7a39ce04b27e25779b46b352d139656406cb26232d98 d7ba8268d082663aed954b3124afc74f1117a818209af9b26a6b8520daf97205 d84b285550e986c9db72d50d4871dca36715edd4e06955135782abdf41c5a670 d93a803d3373f4e5ef1a917798751f8f2540f6919dfb9ff865ecc487901d0297 da2514674062e65f71eaac816c9c7ee20d0e08b14d952da64e041adf2ed1c9be dc0c1d561fdd1ec3e4a94f6cde34d6db36a2c26b214a9eb3900054e03997ba33 e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16 ec76f73019b34a8a1fb0b3e43c47a0cc587a727dac53dc5810455f16347e7f7d ee0ce4b54e41b544f5f3814794bc8c70080b1d74924cf7e1a20b7b5a03a4de9b f40b945cca652d274e0dd584015b89245feab6f073b446161653c5d647a62fa8 f49a39ac9a74870fc8732af0f8643a1b6bf7e4011709a738da570604e1c21ff0 fc778b6a52f7b8e4f388d689c3c3bc34fb3b60ff3e3207e00a2f9d513e2ee3a8",
        "CC-BY-NC-ND-3.0": "01284dbef179aa0b36da34ca28b0a3afd578a7ec405b88b150fa3daeaddb8aa3 03acef8bccd4b6a5c403a6411d51c43596fed2c2c007ea84c5280dfb2fcf18d9 0617c2464e4a3119573aaf940b9dabf844135006bda5c51fa35f9cfcfb069500 079c23a9e9106cf06ab8eb2636ff96bbe7ecec1e8617404d575cba3abf6211b8 0ad958680eae83af12344284b3f365b344e84edb49fa5b3c36d54320807dd2ad 0d125509dd5413f0fd48ea1a714c14a07ae3fdc7c47813581b545537f1b3ae03 1462b07a7d069d1826ad490ec85499b302daef9c0925f2a3452e6f2d062b8326 17d3cc91056263a57958defa6084d47f5724ae6967ba37f582d30d9eb5372170 18b2aaf35872142c0686aab75269523908410c376f89768e248a90b373e38cc2 1934ca1fa44a975e86e9a6bb1985fb9d4521a607fd6a4cb39f7ddf16ebd41db2 1c7596389279b4008bea8d59d231e3581746462bb43173b72ae14f2a52fe76bf 1dc649a3fe1ba8318a12a79a4431cc7209f066f63ddfbce695ff29a560ddc993 246f31f95cfe230869f152d111be8ade9e482e3137fbc6b1f40aae6f64f3afc0 258c99470f354297d11d38853d352a682b1bddf96dde0f1cf7eb92e5d13ef320 28a8a5a299e643728f10a4510cce3ee491365fd7995c4fc11ae8371a2b53b3eb 2b55fda856507a46bfd038677f6f3e0823427701066f42ab960d79f799078799 2f68f9dcb2e5d5665eccbf682b5340dfc6dc3aef1f1dcb18beaf1d7053fb2500 3387362e1bafea57dba80244e0e0b0485de0f51a6aaaf5ac464c0bcc2bf0fb15 341f3585896926aeb0c0057f860657d0c923aa9eaece52e1cb076c43a4202712 38a47b5af95f1194f308345c7f87182fe554e960c6bad3856e01dc35a1a6119c 3c4bcbe1e435e38d51b19cbca060cbf49e46dde4d585b127cb0d25308af6b53e 3e93528d37a0f08f871dc68549ae1bf4fba78a2c77b926c3056301ec2c17cda9 3ec7fa1308794238d8f81f2f9a5209a05949e8588a560fbbae6c1f2be80ecdd7 404090ac8103f2da9730f40b64c36c833c564a92cdcceb701afcf43cb33cadc1 42b2a81f75b1d3a5d7aae4c2d23f399c47a8caa57e7b212a5c60daaa79393385 4413307c4621272ea3b448fd946a2f4a86ca583a507a52ef3abe24e3e3bda70f 498d5ac6fe40a8e066d6839d96b6d916a9d21df8ba4ec04cf1f13b6394f4b106 4affb3c8779772a1fad75561777062ed3474b6a560b84156ca8fd2fcda445809 4ce58afc49497528a0aac013abac4918dd3f742dab1f4704b3ad59304eb15d66 52a1183e7d4f32acd798cb835b896488640f2e4ef070b8a28aa1bedcf3d3f93b 53838dffc9b45e4c48d896f4967b4780663893755c1b93f89b95dc69d73d3334 538b4655a1faeb626c2a61ea340ea758652e535e5802da893d7dfbc5f5f42c7a 57673cd7cd39cee0701e9bbf5c68e4fa0c7591c6ae1fcd5b482b560921d631d3 656022e8f06149284f3c2751f1cce31ef10a02f51ed42f0fab237e5745ab39ee 724c71e5e9bfb314c690f306988565932b1b5a299b15b20cec8ed4aae156a439 7d86d885d89c5280e5121cfa37efd8b2ff9affaee8d5416facc98e058319ffd3 851e255a367614bce834245d63a6990c8489d50302e6f6757aa4121cb73958a8 885683b9e5b22915e4f04c4811ed1e9c7fbc1906e8c12e9eda08a3965bf9d628 889f81990e096ac3b2ce8f3f96bf2916a277ea575b4451562278f282a325653f 8aa029d69d183f33362c064a774b29cd77cb647fd0a821bc5ebf4de066356b78 99fb00087fb24f4b6c5145129c49190715c3a505d219217406b7445b4bef4c0d 9c0284197cd52b3a3444f8cc325f9ee1ba7001ce873a98d3dd7134cb8333ce53 9e792a380bd6401c9b336b924e783eaf4788b6705c0a5fe0389320d9d7540c81 a2409c5237c7cc7a29d32a42a31dcf3037711e6c7de886f8aa59fb46f10c2a9a a6f5513bcebd554abea01415778e82d9e301a58eaa8db0aa120cffa3cf16d0ff aa36ceff9125e85f9980a2a4beffb0599f41a9bf1ae3687410dda82e419ec43e acc780ab95ad6908b3d298f01f095dc09502301b02074e5e265652ad893c217e ae34ebf6cbaded124d792841bef231b5430c5176bf4c1368c37a69b1eace0ff5 b0e0d326ceb7df26f71059e4e45f32c379ad07c3b7cc8735f44e01673553d078 b1978b46b901d83d2ad665b06ac9545ddadb9c360173a29c6474199081ef15ae b5cca4bde2d0f62f8d59121af01858c6145fecf387dcf7d86573456fbb0cd986 bc3e95c69560291777d376862b1e615d5fb9f79ed5192b3ea85bcd9645541f52 c15fff858ac8c3dca2da21cbd2a3281d9b55fda922d57b5c4c77188ed99e8447 c35598f0e1a6583a4f916ab230728511d1b3686365a3779a599739b725276839 c6a79dd0aadd7e2c241cc975cfb45eeb25086718bec167191f4b812000b8c935 c80d8c2ee934e289a26de1d8e1b319b86fc25dba3be53abaddce94db577a2276 c8c24766e6579bfc09f533d21f25fb608cce4fe5d4ff53ca4bc01271fc8c0728 c8c39c3e9fb19644d05e17b3727ab5a62c3e13100cde9539b38450dd710d2ab0 d27c2fbbae74171e522aef8da65e76eac100aa04314d3bf5dc8e4688dc934510 de4ffc245c6008bae0da1965aa9b3a88816476bc92fc36776141752b195834d3 e230b3cb754297ab0c0ccfee9e6d1f40942fe07e934477df6d9b02d2edbc30f1 e46897d4af680267e9c2851bcb4ad3d2cd7eea2c5c6b06f05b0133e5a63a22ab e54ae8ba88cdd9b7133f5c65935f836c901febd99a00f785e0e6f042c2e78e79 e86e358c8f54f9c28d10fda1da93e4b3c8faabf2e069d1612a7159a00601f39c ec7811cf4a308e1eb74de2725b6c905013c2ab290c754c88a4bbc94cc79e7823 ed347b39dc3367ce283682d082dc3a1bfefa2fa2413cf5e25b301f2d0f3ffe76 f09578e9ea4a2b1a6d6a9c54b1fd63e29bf42f7c356ddc99aac5f1beca658e99 f591f6b1f02d0653acfc1942a4d5525f9dd8a8690bb48c35b882e6dd72e8407c f96968423e469eac353d840e1426ddaea27000eacae1f5d0394c2d004ff80a15 fa9b80f7c7e3386b478771ffd9ae865f7c5b18a9f2f4d95e5cbeee3e4a5eed6e fc61d73020a7b19e967e41c691ce90d93d3d114a30b593c61bcc80e5827502e7 fe6c9475d9bf0ec98acd2fefd66b68b6ad1b714310865634ae9201fd147a9ced ffcc0396ab106a9df377b0e90d312636def03002b2aee806a3e7aa5ae52db61b",
        "CC-BY-NC-ND-4.0": "097be4d625c0c94f488cec0cea59a8c19c5cc1b6bb3a6e46691363e0361c823c 12058360c45fc20a92477199d3ac3f8669fb5e36556d9e7acde7fdf2e3dd224b 1804e9af6fc336a2bd406a9c8dd44fa70b8fd4d25b270f114be38607279db002 1835f2f91f471f175c1e280ffa4df8c026512d0db0d837d4687897b4f230d96b 183ddd67dfb5dc29af89af1a481cbf711f019430be98a56217a354c9bea943a9 1c4630df23a18f8002ac4ab4fdbfbf6947c16f2c5f31ea516a41c813a0eceaef 1c773f67595c87ea13a624ee607616e0128cc62162a58a5bfa16b279cc7de881 22aabed8d0da553f559229bee336bcd289c37a83faf0efd032783767aba55590 24d9bd0af56f36e91292ef8bf27f0832957c5fa325ec2e4a3c63596e05bb71ae 28a3ca38ba565ccfe6da78e28e2e67c619269a9265b2f20be3c44340698a2f46 2d76009493d3ec0738af142fb208d491f552dbc16e96c73322e89ee77106a463 33e80d159c050f5818af61648e7121161208907eaccd07c86bf94bdc4cb4ee0a 3c2dbb3fe685684b8e933f639752c48b6ac91f5bf1321f6a5a12c4c164dc5095 3cc2f5a6d6542679cb475c8045036f9a64a92ae1a83f14a12a5ca4debac6ad74 3f3ca431406bb146f3d23bdfeef108f4803922eec5f07fb20870edd88aeb0ecb 41cf090e0ce0f6ebcc70cf494b61029970ff7c158dd6c92ee1b127b699e23160 4378c8c1e0dbfecfcd470d2819374262b901e8bd042cbf3c66780a3232ad472d 444a6bd6c6549450bf90ca7dcbee42874e0e8d883c92a5e88d583958e57ee8fa 457ff3ed782418a0083651a7e28d7054d5c67539b2456b8219e04d37456837c5 46c493076c4940b2df9fb7914d87985ac4b0958bb62b8993800318e39201fb50 4bd8e8f6a5855f9f0e4fa13f241b7b3e116777180b3d46ac1589bd19fe66327d 4ea1da6509b54d0d3651814e4e8b942ff286fa4c6a0be497314aa0fea7649b07 52a08c2bf7088588583ff36f211aafdecad18bda7c54c418d83667fafdaa46dd 591d9659b028df15aefcf820e9743a137c50b2e640959b78ac8af15e4de3ef26 5fd6984983a0b5899cf47e32f3d1dad70048f33ec727a483611ee1c67a0880fa 60f22f1c70b59e649a561fac2bcba6d03878b2b1dc5635f3661b6c900285bdd3 66a7d2ac6b6174915de0cf93448f353be090dfa0d990d6960d56b1947ae76349 6956eb98d2360787fc4266a9f051d58c7a0d398dc4c4fed1c9662d306afd3e4b 6bf5a5b55a5479b2e18a59278b8cde1a222e277cdbde29a430c1e1f3aadd022e 6f68dd563a49fee5ccdac425b1b67c53ba912bb7f85c0e06422a12d802f39773 762d3bf27d42721bf15150d28d643d0fe82a8796dd0a076559a8344d578ba492 7b90b85807aa23328ea611768eafb620126bd7c87ab1aaa8d46a487442460c21 82b54f01c4692cc9caa8573dec6fe6069682b1b6700c8c65b91e47660824ae77 82bc8a702bade32674b7f8cd221b7d9cb180af4a0d02947ee2f4657ad626f336 84a518f4bb26e7ff2801a3876d42b9922793a64e7b073aad8fb9b7223df07b0a 95be938dbc64da6686c5a9e6f7bad9e46034bb2a1beb032a511eb4175715d511 988ee0d4ae83daecd1811ba47d5581d207387095ea1b4ec2afe4ebc4f2febb95 99b0d530407a82c1df7d720564a7c3185e7ee5800c9310908b9fd1275900ed29 9c9a8afca3007defc393bf5bef32df287d2f0d0bee4283c5e6e8785dde0cd95f a1526b480737e0a1472135e8242f6d75f0276fd5e9e5faa7adaaacb532748c7f a2bf5da56a4f01b818fc95fb2e0ec47a03fd697c5c5eed9c2476adfc0e7527fc ad9d6f4e6764e8a70e6e5b30d656a119f20ac8d568816fbf588ed348fbb8b3ec b2461a445dae5d1225c81f58975c4522302d45ce6c779681b497d4cdb31db810 b25bdc25368276d9ef073d6c53658412011f370d80375c6f2e1dc04422764cd4 b745b646874ad5fa766f7bd864a6c7bcc944444b1cab27333992935c0607416f b8f02c445fe4dad0ba83e29066f8d919c966d1122d6b215cc4e13a1b359b353d b99c0eb4f4aeae380f74ea6cedd7c8f852d490a1c6ae6abbea3eabd036b7fbd2 bb09056535ce360f7e4545eb5e03b965f7195e229d28be4ba4be0a9ab0abed54 bb5ad0e8bc1164e62dd1b6f761589cd900d66410664394b4ed6936fbf02115a3 bbfb2d1f85eb8b89c821547683145ddddfdfdaccc413254f87afca23c67f0ea2 be88b1dc8db883eedd461c9936f1ef387e2bc3bc8c7279eb15f9a499bd907fe1 bf43472f929cbc52ff4ce36f1f7d44ea6adaaf8dee71b6d2eed61184867a0b4d bf6cfc11a1c30fd94cbe4c977c609bb87435cc4063858dc1920b81254e9132b4 c0af14c6b8b162b687586acab66f4e2191dce60139508a6737e9c3c45f6e45eb c0e94a1a748e893abfc2905ed9869a94899726c3ab99a35aac3223b777204fbd c322bdb7b5c3496627100bd368d02c64393321c63d229fef8f81048619890807 c7dc44e4f26c2e61d3cebaefde85fcd7f62650b27a00eb4a845cd29a57494554 c9c57aee1e94aa3f1650adee94a9d41ca175d13b2c59d652bdb9cdf17988ec08 caf109eef28a16cdbb4d01b412233f1ddf95f7a392685dfad5728ab50fc27fda cdbc2a23644e5fa949858ddc515842b8c6a3298dd0856bf91150e05b34021967 cdf95fe6a6fb5cbf29e2e9a9fd7f258a248c34c09dd0aa16b98a014b83d76666 d1b92986fb25c2720dd3f121fb060809c3ad7b1eaa68f2fe5727751af2a69b9b d3ad849883e8d5ec3a324ff360eb2f6348cddf7e21bad2ab2b3834e11f4961d8 d3d01dc52acd68ca6b4d33e5f6f08194015bf43e7f268927829c7aea2af4c84d d5358e1ec0bd0fecb014292d4bcb52be50e34756cb6d23966460d563bd1cbbd9 d6473eb8aeae4ef03aba568e365afe7264bc0c6d7b80999f1a23b1de9e3be3ca d9ad3fb09e2951ed422ebd25174461d2842e64f603bfe5e49cf0b09f70f6d461 e1e4de94972c1a63765571d90d28443d6ca1a7b839272db4d529c115f6aa42d1 e8d78d907a17aed264604037178a923b597f56b41afea40d11915c816764a1f3 eaa4ed5826ab413796beb016c57877b0b437612954d3f78348ac7af392b851de f21c06cdb24c2a9130c8a3e74d01cad988adac79982ba1bfac205fac09b17bf3 f3c42312b71e6b5efcbe7934741456a8770f76fb99007d7db86a7ed24fe5735d fb64f5939f5fe7ab0e878d2eec1dee0fec1fc230dbd8498eb998ee999e537ead",
        "CC-BY-NC-SA-3.0": "0053e60d9e8181cf01dff5e6da6f5da0a416bfe836f49e1187939c566d9a49e6 02b58fafcebdfd4fdb831bb2183c8ab4ab17454062932ba2e56130053ebcd377 032cdb6992249ffddac98d2a9c5060408ed6fd0dae13f62768185da7017295b3 03805c9633a4e4b864d075a95739e095dfb57675adbf4f535210e890d7620e21 0a49f1916735447ace09d0198ab58327b3046c040cd14377ee853cfda495fc0b 0ee2db1c46e692c964c3ef551254d854bddbf5b7448977699e5e64b1a0b9f176 0f5c9900c60970e4406f55c3875b3d846dac9b9de03f6c04a7494b7aa58352c4 16f87acc54a287ca6a134e0af408a96b70283583193d52e0b2ccfc4bc30a8dff 17f47664f14f943aa1cd5f16d0542d028755eae456788fa67e0ec6f25cebe2ce 1ca3852eb03e5fb0bc9473f5b93772db11cd019413451cad91180978fc0de83f 1e15aee7453e290eb418d4ee06926cc2dd2f6388a78c951542641fd01c2f481d 1f6c50019d196ea90d2f5645f138981e6a35e5134f3955f2a0be705f3d3c03ea 203cfee1cfb78e2cccc0f384dd4b92632c75ec9e3918eb2e0d079f6d1640875f 23ddd5650dd4f1ebeca36d79576c02ac9935a1cdcf3b85afbfed8b18bc5037ef 255f21b12b585c23bd5ebc761e705bf634dd6dde05fa22e4b9530d1e02572d30 29cd7af921ddd5f6ede62b7a8803e38a010fb74fb83e4074f644345acda37cf2 32d093d2c98813aba01821aa4ec2282fffe3aadbcc74a3fd333349eb3ddfe58b 32d41899d20f17cc41957c51faba15893b95a44c541bed5335390c65e689f6ef 36f0c77aaf6909095f3534a0537cf6f83dbfaf27affa869509bbeb5287917d72 37947d66bfa0804c3eff948f5e83bce7c874bebac86f7c95fa7482f6184d90de 3b6fffc56013701d2c29417b9100559bf977063b682d2684aca0b0ee3dd452e9 3c150d1f91b460e04ddf21347f199730aa9f2f64b331bf10c64da72351ec580a 41f45010a1474c6fe363d321a005a99444d5be15d16b8a39adb7068222ddd9b5 436b2f7bcdf981fd48c4b66f2ee79380f26bdc82c9da2d316365eafe24681669 43ac399ba60585868f2978eb2d821ad7ae29d32a5ccd4592be7a1ab7ae4e296c 48a4eeeab8bd9eeb126d5767358f66d57b41fb56131833880c0dabf0b1d8b170 4bdaf758f22979383c34d1b4bb3c14b2898cc208979501ede23f04659d7bb244 5d5ac8e48c0de887187fb1363de5997762720a1af8870fc3f1d1536fcb390a69 60bd0b0630cda6c723a2b28408694a34d952c45bb11fc69221d0d860ae9f9fae 61a231543640251d8f711467be3c06cb25e8ca56d0ac0f998f0667204073474a 6a7c2554903b492c43dd88cde1a5f3e22fc46ba7cfd275a2483869babd86a770 6b98515cccc16d0744b1754ef6647872a9a99f8458b55229e65f5de12f3dadf5 6c279daccc6017464da20522e76bfb8aefeb0e4d487ee8af7fcfe7b6342c3a80 73d0207a15829e1d046724798364f5cb263bc9478a603de8642d9bc76073500f 752c3960bdcd840a994757bf77bb072af53be1dbf0cd6f1ab14479518eeb7437 776c74f8372e0ef5afcf88d3877ffbd8c560bd53fe469849ef8485144ee41a33 7d5c168854613f9022332fdf98e426b7b48c7c56b685a1d724d6fd3618d3056e 7ec581827878f9bb373bc77f0ec773b399958545cf1ee82e8b68a0cdab06dcd8 83ed884e8d1d6a42d239977718bd98278e1412e9b121e5c19af07df3c886a99a 83f78448819b90213ec1fdd4f53d2eb70192f125ae2ac2b1e70ba75795bd5f75 8791af86f89de2a2493b503cc3d8aac8ecb7fc3d0ef49138633a0a99088a37d1 87c28126ecf8845ba1fed6bd98d02ffeeab29125a3c5078bfbd0815b260e1e28 8c9dc1fc53cd337bc9cd82c7339bafb5a84a6d5ea362b13addd7258155f14369 8d2f8de6395d87b9bf0d8428ff0b0fb6310fbd8d567a6851ccec32cf40465e92 905b81f040f5eaeff1fe5fda5cf6b699cd88114b4121ae0c040a42e102e92e1d 9286959b1e8622163e618f5fe1025803c376c4c3a42347c95dcbc3ce4481db19 9359586d7880d963bdd5f6ddeb0532f1444c6fb420dfb35212d274bb7291d686 93f1163dc9bbf9fe22948ded7c9b8eae7db1aec95723ddf93e46a15fb32f6e17 94db6dc2f8adbd5117418edcd9cba24702ed9fe288b5eb9eb5550ec15066d245 975e0c6e998a3c6208279ffcc66e95ab6bc595f800de2ef14fdbe757bf122140 98a2ebcb9b567c6902926f950639f8a21fe37cf23e61a6d7b31c1934fd83137f 98db624d270c95534d497bdd94ad8fc275f49f3cada30c90a89618fe00b075ed 99dcf0d12edf8635458187d141a1e67b991d117c2ca78839fc4060f2b20187c4 9bd52913a56133b6f9a5e52783d8b284e3a1d18619bc91c21726e3182c0ade22 9e830c2c8807039c18b2cfd9270ac9c3a75dc1c836fdc1501426ba6b4afcca3c a22263b9735a624271c1b8a4cc530df3e2476c29fc8dfb0fb533955b709a7d55 a65c35eef3687990c74aa4901a545954cb6128fca957d7f8d5a9ce645033b072 aa7eb1e4abe75881303e4e12949e368264f4760fb26c221e5bc1ae0a3f9c6225 b3fae848a6940069c9ef26a53d325cb730ffe7aeff2cc394988d7df982b53e16 b605cb8ff2cefd0b3ae036381775d1e6b61e50b1633920d29d1ac26941d52052 bf5ac98107bcdbbf5c5cd66e629639e28f68dbf0911ab3ba9a7f174acfe3d7c0 c85c33142eec4cd0098116b33312f44d7cdf3a97422f0c113c8fa577473256b1 d20ccc102c08edf7f885c0fb3032ed4a878dc5e5a652dcbac69e8a5da5885898 d247a56fb243f00554cb1cfd66679164dae4c4c01fee08a433a24c3db3a59a84 d6b6475db30719da3db0ced8c946c2d9711fa4100ee9021970547517b7fdb8df d85483969b453d7291c63903b6003d80ed30b1c7d97f40cbe9227768ae609af5 e22aa12b2dd5dbf8c3ad29bc7332b3794378b5e59183dfeb1b9d8db9fd51cc9e eae42256f87a22618dd09382818550db9f395f7e2b09686dac1834b37b6eb62c ec33842b8518653ada5be515f1be1c341e3107fcffc3e1bcec6c388f76c14264 eca7d65e80d9d0443c28cb3f92ba46808110586235ee83d77bd93c9b17609cb6 eea345976b58af65ca0d14679f217609f7ab2363baab2795228c8a5e744ac1ce f883403952e54a0040022e464b23a5097b70d6a34f6e64ac01b24652205262c3 fa1e444981be89de5ee8d2009186b2e10e93a743b2ddbea26c378708070d1ea3",
        "CC-BY-NC-SA-4.0": "00b9909f1d3d4685499fdde7fce848f626eaa7a2e650c87a60000584985d84c9 0463ff04d29601e7765d07a0fc90c4a5c81e5ccddc85c28198e1dfa29b29455d 062dd0bc5732cff67c6ffedf199c9558f14b47edcc79bb679b18905eb3c15a16 07b13c1670d87daca664ca54539a0c929abd1928044aee21c0b14ea28a24f450 097e26c40e17d3397b5212758e787a0eef7666402aa2e403982fd895d1beb4da 0aeb1b29a4927eaff82e469f706c7c04fb61bd40a96b125dd25703a60610c5c2 0ed93a166a5db2f92b372ac3a4da05abffdb4276f0b09dcfd8d3f1d3b5373f5b 0f0c7bf77d1712f91e721f2512b4e366154562d02f09c6645b8ce9fefd5c33f2 0f38423767ee762be5998e78449b372f180921e5ce5cd5ae75a4ce01e098468e 1f468e34fbbe6a7e163be16d1c939e4b9ca1e6a06ac02f49aca8fbda0d475885 229988fed6c86f1b08ed01dba414cb43e20b02682b66e01509c9682471550870 27f66e5d9c65a83eafd0632f6141cbed461893e10b9c1f07a9c0afdc1f3b9611 2a243229e0132fa20c18b39398b38843f8ec66f6ca3bed19e0a7d3907398c03d 2d9231f6408a3e5a1d7f9d156964b24c8e5aa3d2457b0257a792d0d5ea09ba1b 2f0fede52745d3113aa5fb6ae5058dc687e8b191236e171a570c49da8d6e322d 314787757e358cdccd4cecc0b10799cf7729ba9994e27d2740743fd3b2be159e 35baffc63604364d2db7a20e8f20e370420ffb86d2556f0b80dddca40a60d852 36fbf70ac0e951b45e6d1df3983f1adce37163727628014ef51c20b60caad3f8 3e4a8d41753ac064d519cb4096ff5f87d94209b23f53865ee5e4662f8600a2b9 44488034a87f39e847ed3b0e70afef3f03d7a975d64e87a05c54658185e4f8e4 48abd269c86acd0813fc7d9aabc09840e1b47fe4409e140dfa3bf8ee73f9bb08 5528437dfaa9929e69e87ff4bb3d315c04f1813ea2c5d9773538cc8b7ce73bff 583517c22f263d577d4d1ba3c26b4cf907fa502d4dd367afc6f93257ee88312e 58abfd1f742065c6b03be313df258121ad42a358424d2e22ce97dacf68af92e3 5bdf765e85b6bd43911523ca4fe927fe3c523150d5a4db3497e632d141aeee5d 5f8bb853ce63fe489ccc33978575e93729d9d66d8f171c582f8a88121811221a 62464c1014e09bc7835c96b010b55f97786662a816f9c22d74307b7ddc12367f 668816623d5c04c3cc98d57cd194a0c4c5dcf443b0eb84d38c79fae484c99fc3 67261fd9adef1d7db46c66999f154ddd1a5b62365638bdffcc63e765bee89be3 687fceba4c12b94a3fe45a3e6e4491cfb2948174a9c77f531c040b4f17492d5b 6933041f1559d254f34ecd803c763a4f37f01097678be8ff853aceb2d7afc578 6bf9f3385d1b44996ab9ae28b853cddf0035e7903a0272b071e646e91b143187 7524acf5e407b22a78081c5f508eccfca15ed16995635b3a18dc2acc772f6271 794510ed027a4298f81acd23ef275839b0056d9c8ab59466a2257305f00a1178 7a73148afc5c7bb0af1c8c61ec7cb913ae72aa5030de2b52d9838246d86fb268 7c2aa2ae35a5070e63b3911134ce568e3059f2a02bb5e8185d0d796fd9740d3f 7e727e1832a806f01674a6c7b2a008616a4529017e4dd8c129f3c2cb45e3830e 81309aa43a9ffd787bdf7a3201a13426464576bc8f2e4fcee8c4c2f4656f2210 873d671f60d5a2b8a4b59362a9ab2e99292a79d5a085e061ed591ab61352376a 964ed90b9a2908e59e9480358f890106f3e9202c9698d3bf258d76b6d2150370 9761f070a058e36148e64a3d4003bab4a49e9a380664a6c6173664567ee0c04c 98a9d878b19860ae802288ccff47e64d54a77deff0192343e9c67d493f6422e3 98ddfe6c8b38289386a4aeb70d1bf1e1338ed41cdbad5e750ea0e0a5d500620a 9b455e1357fcfdfc11d5e020e177609c2e1e5ca5f0327e9169f3edd7aeff5e9a 9c27875f9bc644d68ed8a4eae3d652c8d037f8636d72505e9421a77331062127 9e89b818d5227fb662690b128537e6c14171f86e6eed1d60a98e13286c2fa689 a19b345ea1ac164255ab3bdcb34d35cd7fce4adfbe71468224805216efbc6180 a9e921d2f5ba786e0a46c52c5548030df83b67ba58a22a6c2256253c446841c8 a9fee6244f1b0b8eb755f5d524b6883a34b595a2fda1a3e9253a0ac0e47da436 b460f19b30f9f07bfc549cce6104b559bf6f7474da574b86e6a619401809866f b5847a8a30d5b5e158c2bbf3084aa78325d1ac27260440db090f0975ee5a1eee b60ff13195c834c0a6a2245acd58254cd55903a9c356a87628d5b0d49d7dff63 bbf2833686eaae5943859772d83fbae535d8ed8d4fdf372f41574a84bb30f0c4 be0b19d383ba36f55da250c4bcf4daad4b1a469683014437bcd52f0216f0e66b bec6b0be547847978cec033883850c869269414bbe128702c70b3b7200b421fd c21c2433e23e637221c9597b13663979569014d3cfc474358b61b1a6ab8aa693 c41f585c38cfb7941d5fd38ec57e11a4912189877a884c66c012709345854b2d cac1e4df2f3b96108aaadd8aa762b4fa00b0f0f64c12bce3206215a2a6cda182 db9fc0ef0c377b9c2ee71dc3a0a44d408bde3ee9493a7595da113fa4dc9e3b03 dc2959b69d1edd1ff4ad8ed05612bdd9129229ed657843744eadf1749addbb5b dc46f0b14b5727a62b9a0f1568172f2ad576e484b52b25c79bf0c52d69a2317f dc6ef7b8118ef4f02144bc3a12a2c3a238895acbf64c09fa73da1b76e9b6b627 e1309f55b2ed0a2f52cccb50a0e9c9b3dbcf1b611a53f50f4436c5e1a7d2487e e36155032ab32bbba617c7b9fdaad3066a1d33545c5f0fe1d4cf148d5dbf3474 e7e03590b272a6c91c3583fdebb9a1cd451ebf152394648a9d369224da3caacb e80c8ff6108ab4b32e2052a64ede236440da905835ae5597bc45d6c3d019e1b8 eb332d15d4ae84e05d5927fff8356cb696afeb7074d23954bfe03fa11d935344 ec69f2c7f85024ed6e579407e1d9f31913d3ed209533dd37e33bcbe6b143f6a5 edc73c9dce0be68c740b4d6cc00c83419f032071df0ed53835bfdef971c6ead6 ef67f773ea679f9a8772a59cdba9df53178fab7237a4fad452d6b4761de30530 f1b68fbfe0e301ae878481a7e108fa3cf5bc400bf1e868b3943d2ab98ba2289b f9c2c85492ea0d3ddd40e844702d67197febd01e7f40a9a2ffd7bf5727435192 fbfcc5095ce1f7f0275738417dd05568453879b2614a83906a648fa5b4dac5b3",
        "CC-BY-ND-3.0": "00b1d981dfb9618d46f25ecd7338c207ba5cb0645f6389ad95b54cf3fdff2bb5 0cfad9dc892fefd4623672e567df8b1a4370e56361cb52eb84b2b193965964e1 0e1bcc6e4ede56d7268029752b34fbfdf5a7bab33403c51647f178552dbd63d2 0f682ad4cea8142bce537510080f0f8acd5c7c45995584379dcc1f743d62a766 0ffa60129882ef9fc4724003cdf492730b04c33f7ad11acd4706771b476c825f 105c09105c3967b9ca21c1f361a0722cb5eb376f8dfce674f251e9fe88269148 15ebfe14b80cba1696d871a05ba51650c284104341e4ffebb11ba2565967f4b5 206c194bff958ff3ac114df146624c595979cdb24779156eeed942a8a1ccf0b7 21f6d316c4c9bcc8c5f9d63eecd9ebdd8517a440b75c7b46f52014179f03d7c8 2ef1cd6bb41cdb6fcb0bf0ffd3c5ee5e3125d91641d2c81321ecf5c157cbe692 2f647d5a2692d5c13f8971b3fa2a0eedee3d9b3ab3d01df80c58daf2a6a474bc 3fda5b783c7d355ad9de7fa8c68989d14d5c1675e030e522d6a0f984cefccd4a 413f8a4888456cf05c8f4281c5149cb59f60d88d85dab40f3c166df8c6e73d5f 4281213ace0194ba1343b754579d57f46ffc63773c9653b7a6a18f50a13f1144 45ca091eb97cc9f090a6940f25ed9f7eaab45d7398fc9e6473e35dd68c16115f 46ba383f2b292b0405ea606348d81b4db51318c6b170b23fb352becacd10dabb 46c7258f3b055d63aa197836fdfbb027e8f18f9f7d9a99cc48102e95c0ebbc09 49a892f4f1cd6ec71a880db4af44a58ae6b8b485a41d5e05956397204e0cb1d9 4c0e745a8b5959b05756ce18eb6234e1960427b4220142d9f313a1b63d83ee2b 568a77f037f9c1778ddb36b1749aec5ea1327380ecae85c49a30e3be203fdb67 574aa7cad425250adc5599b440b62d713d10b9fe7d8e23f0e60d0b2dbc16ca41 57fa4c5ef4d9ad33984a79f882c4469eb314559b099e26d0f68866fc11444c34 5831d45caca43249dc096f789b7809b2ebcf97a172832de8b5eba39eb9b7ab86 59d2c1e9ddc47ce15498187fa8307280f349e1fec3d2167d4f795dafddc8bf2d 5a7eecc22b5248b3ff1377a2c5f064bd8ff32aa3472d91e4f3b93aae6ba74757 5d11a7a54069600b5865d43f473de1df648a649e27e1d419cd4ec12ba9167b07 608e36de0fc61d70f145853d79086041fd3b64f5f71f6678b067074e7466e28b 614d7f7312d8769451f75a95c87105974ffd67e58f5d069303000182d950db0b 64930b3ce83665b80a5ccd06a305b2da8715f7ca50343b47e90e2bf3b3fb2592 67654eec2c89f7641645ee45ec7766fce8c1b8a46c716ad27da05c12e59bfa45 697bea88d90ba9887320673db2f2651014e978a8ee0af18788a5057e2b8bbee6 6a41a5e1ed15246b46b1d4f7f5d081385c90e0965fa692f714b8ceab20039d10 7299900ece03b6084782ac9152ea062941954064301d2712ce4ddb76d8a9ced3 72d75ef8db0c0a38d1d35949b10ab3006f85d25ab8644dc0ce679f8eaca6f0d7 73b815abb094b497498c657e21f5a2472021b5c008bf9824d065de3ec7100467 775984b74a51c92833431158236d5ecd4b29e511381243c38b0401fee6cadb1b 79ece8f66ef5429ebf8312505c1189c908615f96e015938190e09e6422669443 7cb2551025dc7e0a41b20fda545fe82b6d30d769a781ddc435a710a2b644f4e7 82b783d57e78f37af0c924224f590522591eae59cda97c95d87908b257a9b236 843e90af9bbb0ed49bb38817f8ed1c3f33b0cd507dbf990ac71ad73688797bbf 8b34e04cb815185278a19e9946640a4a8d6afc1e556c810130b5a5e23a3088e3 8d29aa130d67d4e27a3a1e919b496e7b456f0fa6529f37a44f9b7c6457d12ed2 8e6cfb44eeb3044056893c191d72a3d3c3af30fb3e6daa354733da533ef2d79c 909ac0774a072898cc22471f5171a37d5678776c84669dd969451240dae44bdc 90ab9b31196b4a2a988abd7145ff52664194ad57f7cd0c5aab57f3e3fcf8037c 93da1f619e9437bd6a8d8e436d00ce699d04dca3bbc75e2cd57ebc8323bea894 9455d09dec6030fd19b82d7ced1a7c7e6563c6b267286c8976983cbcae555f38 9822066e05a98d92a417aa312457a3d77b0c835162a5dfbc0e569b91f5a1585c 9e1b9a63969ecc78b2833102a6843d1bbfa3b945371ed9e732ed0407bd7338d1 a5b898bc24e7f504e98704e8c1b830e9ab0a8a980e1b03f9169dc2027cbc2dc7 a74ceefbd4dced6647ba7f4290fbd13b5dcc545495ed85843311f72364ab71a4 a92598733ebefa7173bb95cd615ab3eb2773eb5ed98ee2a005df555c1aa5a665 ac240ee57d4c4bc1a143ff31a8e4b6897dec6c7b78d7b2bdda3f078067976394 af2d838c63ab3cd4d1a8e1fbfb715a23fb491db78d8e1c9d2aa7e3b78f7b9287 afafa1872ba550801de923e5b8570a413ff63609b7535dbcea0d9c54a3f7660c b042ec13c29ccea8dbb4338251b06801605369309857afc56e231ac75dbb32ba b0dded253384d20e478711f4dea011192e9c752cfe9cd3ed149ac13a44fdc1dc b31e03f4c44e820ff4aaaea2404b54b11f965129f50c1e133a7ec40b7eead6db b57b6b051cc71c688f3472cf94a3ac500da33d8f5321a6ba32d6debc04114394 c15c084681d42f3ad645620f36b955a61de5cfc6a0641b451b42367468c4b9cb c3cc8afdb8a50534da724d00783d6a996488d81f537092f7edf473fec66f4922 c58e97d21b98a989a13a01079e6d1ccbf52a9808b2e5b319e7e6de5ccb09ac59 c9e91643e4d4d1797494ed101a774d5a2ffe1218d903c574ae2e5f4e4b36ea00 d4aed65c7b094c881f00c8ea803c984a325b78dfccc281604bcc08fc17621cf9 d6a6c88b44fcbab1a8bb3c294eb8354111f6b44c2dd15413032084485e51dcdd d92deb5a8c8cf15305b49431c339cd15b6ee5cdc8dee3976bd20461c78f0ee75 dd80856c92f76bb7ad8e336ce145ef123c074d99e300e6ca8d8c40246afd6a14 de7b61096ebae80d08256dc3ec05626d2e6eabb8479c6e4f8bff83c6a304b62e df2ea83cf37149dd005e3bb067cd66dd1998286dbeebc81584e7bebe00168099 e09776b025c41176f2c689a1ba9df97811e5819e2f588183a07c41903012cb76 e6f13e2c7203e0d7fc5e40903261edf2c49bc94fbe305c988ea296ad11abf952 fce5879483bd1a9fa6a59bd4eb8019af34a02d7e185460594a18f19af0ecaa9a fed754f92481b318d1d0064f6ea3ea4af9eef9e316eb03e8dcb2e117d544c2bc",
        "CC-BY-ND-4.0": "02a95befcf2232c247866a36029fc4e97de58a22b8edf37b3a6a20b6134245fa 046af26b9ff60ebb9420b07e8335e7542167a96b986c420300935caa6978e0de 051596e7814ebd458298fc6882854741a76a343aac7ed571609958803707433d 0925807f6d4551f4a6780fed799f3025a65d4f1f58c79af83e5c4ff886a202a2 0d20a674118331839815005a37d5225818d1917ad53382ea4992456ddf0f2caf 1156e4d024301ba7d67539d5163893986493c29171c4ce2ae3894fc7e341a38f 17cf083bb30b68bfbe1ce74dbbb4a02c26e0d260dde2e285790e5a0a229a7e7c 1aaa5d71099bd8c59bb85c84fd967a8b2a21462db1031329f193da3f11993129 1c290c174b90217e94682126f4d7a12fd03257f0db97cfc4199591789f9b0372 1fd51ed840689cb7e217e1d5e18704576515e7db418271d48470e389e05306f6 22bdf7a12831108ad68dd7a1401daf2364a36df862e909efd2b974c600cf7fc1 25437409cdf0f7c5a2cd9db5562e0c893f8fadce4dac87f446f2a107a85535f3 25d2a932dbe4768e381f18076165d79545f5c8fb07839465bba0847979999ef1 2673762ca2790fdc24352bb75d4268bf580a350dfd8cc95230d5f591e6618c16 276387dc1bfbcb1d57be7ce42dee3e8d02f3127ca797cf33cca0f0edb7adf4bf 281a73f4b925439d46d84709b10972c4fb13abce945cc7f17338ae7cdb44f330 2c35e9dd4a8616e323d67174cd245990f69ecae0e5f86835b21e03728fbf725c 2e113a27fb17b73d5717f2b4b0716c2c709a1260458d0d32826c929bea363314 32e9ba55831653a6444d1d05c44f0d53d863be54febd78a095539d8471df0193 3c9bb3138e8e1bb778682ffd96c9dc21063ae3e7fcaabb1bc3f8dcb369671a85 49b5d760b0a082ffb12e891a1914e367131386e2a066acf08d220e534599571a 4ab3e139a811f2e5985a4f5925b1835150fde51309e515db493bbdf59b4f9a89 4f7729548be48516e590874dea6ddde505c9b023e0cf4ac0482617b2b7aaa357 5448a6cfaedec02af984254eb65bb92bc785c89aa744d361256f4436f04017ab 573719658b9090ac124779186d22523d0c2da5d3aacb4fb29eb382f3435327f8 5850075fb40450d2bc61f5279234be8ce65d346973f366df19a41f1ce55594ed 590fb21597558f7978f83055d41318905dd8a82e2d69484eb5ed96b4fd0026e4 5c254b1df4c4ceea09af6a0a544491a850afbefbe2d43fa2fed77c1d0c010083 654bac999cd0f8fee9a214ce4f9506de4a1799899f7b9025f9ca8ec815015cc6 68657b1a6d451727851b2ce69993e2d019c60a2958c29bf972fe8b42e0a79012 68b9a90d9627a5881dee4e60348f844e03269c8f4966cae392a845e55c48ee01 6a5b516ae88859312f1d6a250547afd88fc670f2c8030fab5a84a9ce5a9a817f 6cac07211702cd6bff3fd3018de24fc0f8e1b3d2a944acd6eb5a17d0ecbd088f 6cfb8816b45feec3ccef4960d96f4de880b5371b0524efaf5fcdb98ae6282201 6e7d36dd10dd5374da8977d8fe3d594165b0b619d8e7cac5af92fd059fe53c91 70d08f00a9674d99ef2faa92e8440d31a64ca9a85dbc6a9d7ffa44d40400aa84 73e950d885221f2010c4505b3721d0841ed3c60423746cedae6e2c32604e9664 8108c48a0504e75cc217d9363fdaa1caf6995b84c96b12778f2de8df1b3172ed 814339901e33fc5c377a6737113d462b5ee655edfcd363088b889b4201612018 81de4a4c3792026b90bac27182313c0e77de76d7f8e25ed162692c48279a9ae1 866489b2904b1deeebcf8d19dcdf7f0ecf3b4c298676843d2d4efd863f41e913 8c65407e11a41363b90bd53f4ad4f0f443a744c02afe707e7ea74e5fb79b488a 8e36458dbc389ebe40d6637ef01251238fa464679451ee21c6b4120af0f211f5 91772edde67c4dba1a887e9f3c018920e7c979765185bf4029ea2ea8e90e5e6a 9f256f40af16d8db69b368265574ccf358426b9dee2a03856f7352b462048953 a05c4d4ec6e00822217dca8525b165bdc478d5e5b1a30b4f6564135c847fc34b a27efee3facc5ca117925445c0cca08bbd1331196da1b66865f99c1ec24aa213 a9a7f95674c4aeceb2aefead429dbf2b4b3315ceb136b39623bc0a4e625da943 ae4a3626514e6446e850dee0bd994a0476600088506cc1ec542fff719312b1fa b163eb88ecfb28b815c85dfd756d78d97435d58d4a5d76399f81e4d948f59eaa b3602cc783cdca194a30914c211f81d3f87c8c4cf4c661ddf8eb468e6821ca46 b41df4e05f5821637dee3e85d394cc6cd283d7e29b1d984f24dc48487a74be9c b4e3fc70c251447e561e18a093a963a66887c338bb89dfdbc64e919b8e83d7f8 b536c40dd5651247c7402496700b4e7272348c186738d392acc5193f50770c5f bb3e2f0f08565c5b2aa7fad51ca1a616be53ef027e134b3415ab6bc9281e8dd7 c18714578229100c34d6d121bac7035495982eb33039fede3c539ccf4d826948 c2fcf81d4a51f96bf99064dc45cea76166bbc1b90b05da3d97f666005227e75f c8c089ed93e6f07fc3085f195882d5509f27825d38dde3036faf136fb0a1b670 cb2bfcb3a779380e0b69fb490c63091d808e76518faa2750649ec97e0f9ced8d cb81b21c1932715b060e630a82c14721c96e8854327d2b60e126b3f21463d4d1 cc0895d7f0ec4520ebc38645a29758d6eb286d0dcbc72d02aed9ff7c8b9a8215 cca60af700282770c599adae601cd8655cc1b11bebef6df3b7ed33b1901a2bd4 d039e6248e930d207da703c32312648af57670204698e1527baf8646cdcecccc d302c10c2d2ebc251b33d70ba6f1d573fccc06fefa35a70efecc3c13e85e5307 d4e434dcd4cd58e1faa2ce664c95622c5fade0fc761181bd821e7b36d20758d0 d5a6ebeb82acc11018c315afa6fb03f178cf8d99f282cb5e5f90b4a484869f1e d7178ec1e3e118dd5be5c6cc058121dda2964ca9884112dd1117d1926c730291 dbb68f2b03759e441ebbc8395f7aee45ea9bdd8fc1621b9203df93b6dc421704 e29ff3a2441242b6438610517b4e18607c417ed70c5b2ce3e5ac2cf87640241e ea9c4842778586b1530341183e957bc860d04f10e772238f21ebb9f5828bd73e f107f4307e9c02f806dd53c6a5581efe2a3e2780161e3c96595727e9d9116a35 faf97e1ef9a4d56ca9cd9a465c5b1cab1b825deceed562de1cbeae24ed56e04a ffaf878b9c6fe0371ba92ed92874a243a75759f130a2edbade2d0b87d239a9f0",
        "CC-BY-SA-3.0": "05dd783e287fae0ce79bac455d10d7f39d8bdacb92faeaa8100a1edc5e0f4c48 0f06b8e482ef263f48ca52be29c791b12a62c726ffb3c4d7bb487815a5488da3 1159ced765e78a68e7b1bd1c67a7965d92c24924d4e2933a81c8b72200d1e26c 143a258c02534301fb7faf3d218a4411d6155e2f8531b2bc431694c909800231 1c84f9b41b746abaf17231721e55736cb3b106d7b34e04d910cab5a31e89610a 1e3128cbfdec7be3edcce3e5c841162e5e006dcd204cca676f3f0746af58be39 20cb1cc561112edfbdd54aa4d4381f22700f4250ba183f4180988e2b30dae98c 24c88fb1e9b69a32303b07cbe1052ac1d10ac8b17201821082d18c50ebb7dec0 284ddb5960ead063e81b85a622d0fce9ec543c05d4cc2db2c336cd4bcf38982e 294e8e483e15e2ad7216408e5eb146133644d3c1ac192510053c9bf078de1cb3 2be7fb850b12c07f029a9ea8c1be78f7975e6ce875bd08758f156f91bba38f14 2d2f83120e546b3903ff3730ab827d43c4559b151db4cbf79974a434a8ab9b67 35c5c09deb823344e4c57b5d269325ca63fa81d77808679b9d3dcd717d12900e 36bab1214f645d3f10eb0f7fb58ec4bac2f46e0c2e6f4628984cac76965fe52e 446439289baaec2e2c09614a800df742b9c1307eaa65df02eee6950da10fbffc 47005c13262d621f6559ea569ec8d08ee4d7e0216c0363be72e17968e0f6d71d 49e2cca9a3c72532ff9b1e85475f8ac123c0ea49890baf9c7734d92f0748080d 4a8c6ec07e9f132de96d998d25175158d7a3f258addab6eeb658d5a0e6f626a7 4cf1e2e1e84a5cbdeae9c92f5d16ebddacef5982e203cc21dbbc2bca0933cb33 4e3f566f8bf1a5e6bde12f21f0f64b627b839d3c1afcc27bd527788567863822 4fc5e7bf33b0a9576646492e62a4e963e4db906599589be6bbc0ea71a0ab6860 5337014eabe1396df83e08a341e4a5a85b909a01176fe302f19bcefdb6db4bb2 56e65935ffd5fcecd20cad27b90386e4b5b04323b21ba351f1a3df1d031ecbc8 5d8639495e8e92410302168490f7b0622256da4ec72e4a70783339419d4a0e51 611be76b5e611acca7f565d3de5c57958fa3a0b982f7c17675b2fdd9483abc22 678930ed204680c23154057c23ba8fa0f793f4a07e6d042a2e680846f453a834 67b138328aa8b9b1ca38a298c08be86a45ae88253f2ca189ba73c7b61e0192e6 684dbdb0e2d3812e63cc974d4c6ed4745c04f57dbaf00ae0c8af1fc619379973 6b306a30bad55517f386587b33f361f1b00883bb21d19fd6b977620e4d264133 6d9384c4c2c239a2801f14f036e869481ca641a16ac1df82c194797531f75735 73b287683eac4f4fbb55c6474e24e8f393e281600ef6d77b33ce8931a84cec5b 73e50d88d3e6783b6a5a24460b45835c77b252122a29c0c7c1b3faaf38ab66e1 7754e2a79ceb0446e28f6f979522c076f205807bb4ed0ee54ae4bbc131f56cca 794c97ffe53cb3f1e80f9c700c5913ec2d654cecb5504c3dca94de0569a3b53b 795a0ea9d71ae0ae49da83cffe5162b277b962f077aedc3afd82502a61195128 7b0c265e967c7ba19571ed677cf935e440157a8822753fd47736ab5f4fbb6c4a 7b2e0e21261b9e0507e6676625ead6758b8fecba8d3d6e3f6c4eabc41958fed8 83cefcad36b8eee694a0bd59a0dbbb79eaa8c0e0a5b12db770a516f8b21df378 8871a77f8cfdbccccd9cb271103722a049c88f29fa61b205baabf2c0e6c79576 889e97b10ba8c5d3f65853dffa075d8f8755b5a5aa05e521da993a1ccce9892b 88fd89bf1e55349abf15fc043cf04feb7ebad7c755eb1b3c87a4d82fd9846880 8aa0e91672dc5e205bf8441082cc3a65df004f0190fde365cbdac7193f580771 8fb8df3df18218e17337f526c27f466a44d99ed5151b26a71395801aede04fa6 9e78fdc650021be9c420c340d4578de9f357138aabe486cd9dd724ca45fc1299 a6c946353fa69da3ec9dcb0df41ff61e9b4b815d8748070982d6e8afcd07b050 a7da850b827d02968449d4936cb3e3f06898bf4d291306a440a57be8b2bcd812 a82794ff8a5e7005bdfafac5e94c18be716715c062e86362dced843740897ea0 aa751f38b09e0105cce182f1d1e846ec9ebd4326ca0748497e67d372421a3366 b14352b04e66ea5ea4966ed942151f3a1d221e392cacbd2a867c207606af0fb7 b1b2c77705e0ffe0e4824324846f0c438e4947cb169d7317350656892f22c06d b4dbdd5365d8576536ceacc95b566851265b933168a064c20137a315004b9c49 b7efdb31e0fb41a31f043fa35f3cdd734234d6eb285256469d518af5f0df6f2b be50f228c9439a5c94c9a99b8a0b068f4c0226a7b091dd8b8167e5bb596184a0 bf439218eaadeaabeb3473ca93f744a37484d500ce74a303654125df921e5362 bfdd544807de95f0ff6cc520a940581289d90238dc73192a8fbb9ff6d3e340c8 c2d42e9d0e43b02d21012cbbf207cb8b500b4efdc83580c49a59695f6a1acad0 c5a6f739135a039c4f6ee8abb4c173e6ace5a7cbf95c1ba1b876825ffe359675 c94d0aa620dea779f8f3482db40a48f5c8aa5ab0514f485ea88a274710bce186 cfc608a54c140f34dca7b959831b4b7463c328c6975a9d6894dd2e73126b4eea d28d2665daebb8a380ea9fdcab9de0d8b2044cf47130883d54e108c11a203571 dbadc417fd7971c03535f79ecc2c4798a6ae740f43eb805e94a93b47a938db9a e0b2391a152a900ca2b6e3889bd176f14a3632d278fc163cb6749976efc714f1 e19ea936a658664d1df39820dc44e2109b1da16aa47f8a4f3712e5bc61e04803 e466feff9b8af9299358981a2caa3eab0aa3bb8bc7928258bdf02eb274f43067 e558dd81d27b431a81d4a4aabf8377cc44bf7910891222b042027597ad782029 e587ff944acf538107688ffb9e82e77a37a40b116e396f6c46c66d0e9f43a90c edc63f5163f8fe42d78fe429a01af71c47dd30cb704cb426e123070d56319106 ee8e0a871f066f602dafcbe5c42a43fed549704e69813914821a9794d3d3a6f8 f3fa4ff7659ca3fed2eb2383dede4060d310a76fcd611137ee37b447db36e052 f4f08353205fa64cce939c306922e89ea91e55503301f75f3e589dac00d46b85 f8b4f6fafc87ba1a8cf5a3f353e3ff7d2d02ee3f272734c19aa680dae4dbf2e1 fba5c65018efc6ea2ee47c3db9952274621daeb209816ba7519ba3f3fcfb711b fd177bb50db67c06599d0f41a6b725061ebe7a88b7d34739f82e5811f6378215",
        "CC-BY-SA-4.0": "00e25daa58ec98bca640c644639fbcb62008a478c07da0d902e01d9eaf29f1fe 020310b5ffaeea54839324031045e0bd4322ee1fbe47c3c24e71e01813fcd597 0b6a94bee254235b1183aacd4465d467abbe2d99c664edb3b5d01306b4755524 0c43fb9282277978aadfc22ad7fc3dc556b592aa61e346ac30b1bd07638d5415 0ec4e047e736c3735cd23a05f4dbf8117e6981ce2b1ff25547d6fe18bbc84b95 11b6b2b3f92778636604624c60bd33402c2cf56a64f572c949cb626903c98649 13a555db5360be0f9bef5b6d4ba6665f457c07f21dea6337f000408aeb0867f7 186cb0c4fdc560bbb0e72722b213b2d59e630f651df96768aa72bdb9fa7b9fe8 1bdd31e87611095f0b12234d064ca6470e42f6aa80fbd5e03f9ae334055f43a9 1cd727d53bab2d29e919221d0334a03ca4574e9338430e1e89495ef614577cb7 2033446bee950fcf82f3adcf35cbf667c2da6ba4944899fb9b812f7605cbc167 29cf40de9f2141f6588179c020342d7f3c05bddedbee8744640a222dc5b096af 2b112a6fd54caf2eae8e23516b628ad8ac20c00e407e568c503a16ef1eabaec2 2f9ad5712faad3249fd10549c6cb2f3530218487e0802d500e0ae4fdfc2d7fd5 39a46887803c896876c1b0bedcf57d1cb3c498ba129ff4befcdfd7bfa0df5717 3b81a3484a87afe2bd7f4db60b4dec05083428226c22ebba03fe4dc71088d26e 3bedd64fa947d92735b37d3a0aea6087dd816d32eeecf22b22e12c14c17f95cf 3cdacf1035a414d270b8727ad8c85f086f27b5e736f1fccaee7504601efff941 3db3ecc597e3a63bca3320d61e838ec8a2b3212c43f0dc02e368a6e6a094724d 40c1a40c2cd961fcae20b3198a129173b83bf6054c5b2ff3bf764e8bf15cd036 4c3f9b93294c031b32e5ad5a9cbad5501b2d3496335ffba7486ff74908e1321b 4fd4271f432388a1c759a997b7c3a199841cb7a6b1b20d58013482cd9372bb77 5039c409a61061da133e92ef99e93e40c2615c4357c1a772a3acd7e3cf153872 55fb62bc123eba7dba7ad0d88506e3ea5d0456e5f1e00d1577aacf31999dd0fd 5757927b52d1f2fcccf6e8679b7b371550b103ba98eba50db1b860853a2427b3 5dcbe49521415ce300e7ecdf60dc91842a773b6db7d44b2cfbb7762a5d7edfc9 6300eb173e06d4b5321e87a1debb8f986d0d2b851a6300ef27d2b9dfcaa51043 64cbecc2e486500e2b6603400c5c16a8803cc88af4022befcaf80f79050845a5 69dc3857f0aba651fd2a4e05cd1e29a4e7b52e980b9cdacf5d4b27d3495e0ac1 72725b645b79f46b52a65d951bb38b7a934af2955f480c6ca075d46566bfba05 72b8298210df83076f89c2b3b0162a680b578ae5a161474405802e25b422c56f 76fb7807c746a6922fddb431f49493942340477629c6472f3a38ffea8abec304 7d6ad81106cdee777b2f45ca75a7257e508fca2e906861deaf37a84fca0b7644 808fc082530b1ea262d6ec5a8cc582d80376c1b0f1312057fefeb8c91c1991a0 815872b69fb0a90bfa0d77af4740f30352be3f417d0183ee394f351939ccd8f4 844730ae6df86b5827fca7d8bfcdf7de29cac93d0a7d710e6152405e2f4e1083 8617756faeb46596f0837ba8ecdb0a9f0ae1ba84ed6b6a38a7a78d3ec7d2c43f 878d7b9ffa05874aa5d44e75ef09e9198c2c990c74c0ec7de2d566766efb3cb2 88c9bccc4377509104b50fee244d17abcd2279430865a1b4fc9bc60894b0c0cb 8c96f93662908b6a064cc3b31da7975053f46ceb9c11fe176ae98edbacd3e8dc 8ecc059c87c58f0e07403cb106855fe07a70b2ab9b4ce7cedba87701fe867e85 909e36d2c256e68d8e80c4e54fa0ae10c1b8b59fbe754f45a2bbdbe5168f446e 91f1be442521e259c3f94d65486be4523d01792f1b98033a673fe192d9b53d87 9505524b9ca97a674b83136a9fda555e7eca94a19f74d3678a3c6d085b0b8f59 9ad4b966581ff9ca9a8c3834647576c11d7277ec80a667d8a06f81476bcef14d 9b8b95a5c7d747c2a79a6b1de90068e96487e4e999765eaf269970ed990f7152 a4b2c3fbd5dc623f021ce3ff39b304663f2390e7d8864fdc4de7a81bcd1d5a87 a857685de996e9fd9d2ef6b1a35378242c3c7649e2471859777d6a1d70444591 a86e723fa8a35674f995440cce2e4dee21c5fa46e0f919aa45623de87a111b3a ad70cd62cc8d8ee553ad1b0f13936761b553e0ce9cb97a3e026a6a00fb24c00e bf1cc685dfecc7be8371dda58576cfd1afb5f3031c504589a01dcca79bbe0143 c2b9eef303bba2a2c3e9dc6137d2ad15c7bfc58dbe5f0d68394a4c5a8bc3aff8 d1008230c9e38808b605b3aa7038a39fbf837f1f7cacc415927f2977695c6669 d1df5e560695ead88abdd47f76d6b5b4b7ba97c48d558a16651d450bc5bd8eb1 d279f6df175a4276ea34a11ba9d38e80d87321bb8cfd64816b29d6f4dad100df d39b0319488c2d7dfb0ca98cbb5d8c2f4e600d6013af2e12877da0789f10013c d8b3204f5c06524b3afed9ec4388fb8ed48fe0bc13fd762687b6588d42dd8feb dc531d0a4273c5eaae1cb1310126786b1f4d40bf15d1b3febeb91b69983802f8 dcf96a0538c336301d0d807e042dcb209eac7ca509f130ed2a1a11fb6f646aed e1b0d36dc3ebfa925c49bd26ea79def81d2030b28d76032abc885f8def519133 e3e71253d00613f6ef56723e9f3f4894de218e66342f2d4bd4c022e79c496af5 e4bd1113ac3f7695e573d97e3e73fa39f6f5c3b5315765a93c54840bd5d63a91 f1d356fc81fae6f933d5378b03b2eb9e0bf78294ab1da36e1e602518207ebf04 f3b1dca423e69628b17777a8e719660750654639db0964219cd6aeac5e223f9a f3d3c7d830563272cb5aee52bd7b52e6932ea9ed9de229fd3b3a8390f2461880 f4600b70855fb65942dd347d4e140c974daf5758873fc7188da48baf435ca1ad f6c76a80276083e62453ce50a52b616b6dd7502dd372338c3b8d22b9f18580ce fb363fa5b92d61494cde1abfa72473d9e0770a130ad0b75e27e3d738b3d9a77e fb90af8b6bfb3f7a19639221c56f101fa83be317317d583099d4dc86596f6ac3 fbbcf9a781a8861bca5970b108e8120c78d2858978ee7a1517e9f13cc92d0eb9 fe2680d16e79f9607e86b0a339ba226b240ce8b3dda6e21cb5a73a0107156537 fea5601d5ef8a9d2a3ca8db8bab2fbbe0d0729b8d95090aa874c9d8b0984668f ff7be61cb34fa76bde7e8710961e94d18abd9f88b9b2d384f445d98bf85844cd",
        "CC0-1.0": "05c4d6be883e8cf01f4e05c3344bccfafe0a642d8c64d8f18489916e62533be4 06afac408cf180bb8693e436dbb2ef0727f4c4203ba3df3c6673b2c0c77064e1 07173c490ef3399219dd121cdd4b56dfa4f09be7c353366dc7ce622c2c6988b3 0826d404874871a7ae854b8b4136f04b82db0d4e01a5be2d5e91057d77c47ad2 0b10f67d9c59a30277195637677b29741cc04455c0aae0c06b1babd50737bfe0 1d974cdfe284d24be32e0e772cd7d5b63dc5463624fac19b261723f39a7d80d1 21ddd1df64a39cb5c260b7e0562ea0d53fda3b703dd0aa1b7c49e79c52c9af01 22155db8f9023449b68f656eb482091eedfce79f183712f706b10d9150273fe1 228cfcbf79522f6d8217c93df900b1103bcc9a049ea9582aa3db1f19b76fbd07 284d0317ec543264df544a8f7d8275142f76edbc6ad596893b238d5564800dd3 2aecef2d9b7eed9f3b36b6692ea7482f6577d85e59fd51dea4aa8edaa7282edd 2c58e892465b5a0ee4093e743a6b7f4f4747b0111e952d1058836d05a6e1835d 2e3223d32cc7c021885b79fc5c0fb269c7c10d522279f03f01b06846a358652c 2fdf21a51010ab433e75d7c0ab5ae0a534a770fa556a5871766a22afc11e6388 30845ff18303e5b0f9644584b006a8ec1d355878bee35b0a4b9876b7513075c1 3c520591bcd62bb2e8ed2a263fb26a8817202081f4f084ab3674bbb386692feb 3f9d6aac95d5f922ad9e0a911aad1401b8907a77aeeaa62200c038f935b16c4b 42b2443edce7b91827e501e16b7b9dfc9dee282d212fa2da801c7d2f85009d29 44f66edcf0ee4902545000fa856e1cb5b84329dcdac29926f5192d3941a099eb 4774102b3119aa2dc28e8354b09a2a810cc2ac0b8e18cf4278b5a93ae506f974 4789c8c7d2feb4cf9ddd0dcb4750dea0b27d20401fb3095674cdf4691740a078 4892a84d772db2b0c6e923a33bab3b07bd1771d11ae16c9cafb4be8fcb06d0e7 4c7b258e26d0e833395ae81193c3c35d4c0b7417cadbef263054f291033dcbfe 55a3688ea5e01e6d02784ea07a01d23958d523a7d201073b01a6dafd11a09e21 58cb3e37d014f59d94b2f9ad3f09d8ad721889bfe52121dbb16f238a12fe6175 58df97e941d0f4d8b78a0a67ab27258e847f413eccc3180fb9ddf694097b23c4 5a48c65473b7cae9851905c115cf798a77904ef39ff0f638646a9e8a467b25fc 5add3b78ad26ca54201ad1bc38af00ec57f9256fd1d7282c58b84fcc8cbe5786 5c9c8062c2922b2bcd20148991500d2e288bea2d3ddc248538c1797079b33199 68291219b4f91d1d7469a4a25cae5c3c14e0a30be2b9becfcc5efecf7150a571 693ba448f48d3dec0901c8e862639786f6695f20fe745a5b1579d76d0da60ab9 72c19484904cd3dfd0c314de96fc736712154d6fb3543907b745aeb4cdbb9e34 739f114600abbac5d2dab64bf05f69b0747bbd47da0a05c0aa7d42c55d5b7c1e 73a13f2595f0660e2b11189e79357be0cf060f185aa219715edfd4e2cf83cbdc 77d09c5292898c2a239ad33b14f63aef6c2169de92192691fb76a05e681abeb3 7c1ddfc7e138f9f4e26e2a206ce1efbd81504b24b4fc84b24df5671c1630975a 7e0d5e0469c23d76784fdc06536e1017f2c47dc46e60a69245cc73902728a005 83cfa6d6670a97aea84d0d476c45c4e238b3c7156167468b4ed0576cfc77ea74 8a28c6c22cb111ee16c49159c448a6149c87932bac943eb9a4d15a1884ec0440 8aa1a38bd90fbc3d0d7bf9e0690dda3f18f73d15e311f7061d919ea3ff071649 8b7161ec56c8aa09eea3f30aa0b5ecfdea181cca818517aaf2db892e2d136029 8bf1b594255ddf41fec17bacd70fa2e45ced56fb6e6fe8b8786f0c454f81c213 8c55d2473e4f9cd5ae7f992c791222df99035aa97a6333e0e51f209306e1c466 8f5a627fb33c9f10726098b7bca7ea5d257a73fb3ddebd9e929685db2ac269b6 9006ccfb34f1014e61544f236c223caef5b7b0eb12a9865035678b60e2649203 93149cafeac4b8a549cf738ceb4e496267641a25e86b0f065f4ea7b7399f9cde 96915353d7a84082bcbf6b803c99c651e279a832da34fbea4ba84c9005155395 96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f 98815ab6d0a9f517a7918dd4f26e726204d53797ac6560a1528dd62cc07bff6e a8084182a56011edb86cecd32bfdfd9974e2c10faa7fe3e9db35f19f247313a8 a8b2365b67720ef6d2442612dde5b185692c38fb57f6f612bc89301cb7ed114a a9e50c8824ccb871be38a177b7670efb90f384594cd0ed09668216fc374e58ad abfe5f151b2435a2937283bd6e60cbdea069703fc7ac1ca774f4eb4131efeb84 afb54c7aa70ec51bb765f080a0a79ea0b3f79aaa9dc56a7c8658d006cf87b16a b6164efff387a0b6ee06c535d994c45ad7f710bf624b5290c9292b4a9b114e35 b6a7787950ec661cd56fea4164a40d32df6a7bdddd7d6ad160099855ee9ba340 bbeef478cbe6ebb93742276c08f957b2216c5bb2835464e45a6c9cda6b5d1ce6 be3b93093c78c7b6d3ef23b2f62e5e1979bcb344db62388eeb2aed0a20b9cece c5d0fb957e2dc9bdf5f77fa22a86f14977f217ba966a29329f21167bbd969fcf c7ae51fae68a7a07dfd57349b221bc7c7218d1c40f3ca0e0a53817d093d9b4f8 c930bbd4bb85dc43e77a76c7bbb6dad81046dc91d8ea692d74fdad2bd2329962 cdf4342c15670663e3c04ac49091080a479fa917e0fac47a4c6eb4c4f8a9f07e ce07ba076dbc372572541b00d043a09d92d9c85400ab69c2633e72ea55f21453 cecfbafb58c44135b88f55ec0925dd7eca79c5e3b140d0320164b67728da6f01 cff2afcf8301cf41652c421df5742e2c4569afacea0ee04099c9961b4f73877c d79ba9549462d4c9f503684bdd28ce021957d439d53ae6c7167243c56bea16b3 de6a5e8fa19c7aac02fb8789de968745713b07d68992916c2cdfb2907c3427e7 e61c179ca59757949f62893b6033fd98424b3524366f7852f8966bc557460d3e e8f584a0b50e3a12beecec2eef28cacbd6b98c0422127513ba0ea8ed8ca840e0 ed91bd0159e833a5ae94c395c5d7d36467554cb58b6d9591ab4c495ce229e9b5 ee48dd8025ceb39875a47250cbeb5908e203913b4d0481e4b44f17cd7d1d874d f7094ec1ef85e56b01c68317957cfe3cae6a316905d02713effdf2812b3bd464 fabd732a32f21a35f06f40de6beab0a75f12ae805b4c38395e920978e8ca9669 fd68fa0f1bb63e305b403783ee0a174c96694d05cf55ae5af77b502aba265d07",
        "EPL-2.0": "00ef978a7e07b1241447fe7955423c1a29b9f9084fc60abbaedb5569f536687a 053bbb115a9d1314d6e53d240c5be8a6f549085646c3a5cf8dd892f248642aad 0a3d951b0a59ed7dd5af671d875fe7a3359abca6ee5edd8cd8597b700e2bb46f 0a953c1449153e4e37e5f6738514aa8e69335cc58ab0d66a022961250bfb56f5 0b3f9c3c8e7d1593679434a3182598c6674dea4257a20d9918b1b75d20135fe9 0ba17493016522189ef896e6c1d1ce10231ba9a9a9da239a2ba482ec7b5f9efd 0dc10bc78451d59825701719fbdc461d3886b0d81f952380c506781e9c9d0ac3 0e5487d67e262a9516717e753e2358352e67f1b3354fa94c1931022218e625d9 1405699bafe8b11d2612c3fa5df4122c55da6394a24df756ea89783bab4a2014 157b65ad7618eb6ca5416563e97758c7c0cda5dd9946f82236dd5553bc203561 1764ce4f068cfe1de6230251a5d4220ab59a2a16558b5d9239ef42765d286365 1a48167f85c4006561d09d7a977d04618eeb719b0e093f99888c5e7769488c99 1e2abdbf87994f80b8015fb42980d6efc1845a3f0c7e64f8426ce241494f4433 1e666cb13f421ecbd3c4e0280818d95813bf0b1e138c4040116b0ea627acb968 1ee9a72aadc4c03b77ded7b904c6f9262dfbdcf8f74e60855a49f72d187e39dc 203d62f91973cd428a6cfbe26948ba538825794dca7c9b0e16ad193be8113315 288e1943bc2997c7b9543cee80f92e18af0b72744c741855b38e008b0addc314 28f52be609148849c1a95a68d4a425cd8045c3921f61c98f49cbf72908073ea3 374e964609c562570c0e325c2a8957e14b3b41491367c0dce3a567d7698ae232 451b15ea44b337d6ceb6e78cca06decf8272081fffc7517b24df2f90cab6668d 478dc4d8b24f69118516e5c279a770a9c111e2d1ddf1ead42197740c5d92c4cc 4c958f9c5f6d2baa11244301de1d5975af280333efb18ae9710c496bd480e98a 50d82dd9edabd0b8bcb6a1ee5d668c10be0ecb7d429c155d80c7f4b3b26f0bd2 743eea4753db5846831221c2362c4da60bfd467eeca0d40e9926ec2d8533cdc8 77a642b5d878afc17c77cc6ed8d8417f04b98411ab2a311c6417edf1e0eba759 7c1a2e9067d7acd821956492cfd72812c399386461d1e38192392474ba32bcce 7db33fe1ceda396ee1f18e6616e567facfb832e62fb775d4fae5ffd27067bab3 7dcbf52f2165ac1513a87b9d7fccdd6c4110686f343ace4bbc93862290454d4e 80b0f4690272307965865cbe1e423d0d1f1986838990ffa5bc5ac12c36f76e0c 88c4c098b8a8defb1cb35e302790aad36f9d607e6e27aa1df8908da839b56367 90a65326bf74c1a80b74cffa85dff0ddb4a9af3957c6eede6c6fdfe31d488452 952fa3a8e1b74d9fd59c289cc862580c87719e7f13764c8b1687f7456db8f847 982425e09b82339ff82d527132d20fab27242c24f3027562c16f394d2e3f90c1 9de8713f328308e639280ab95195da010ea29b6213c8af43ee9d87baa2a1ef91 9f8b03846de8d06d54850b5c810b2f0bef546556273632b6237ffd4f675c3843 b824a3c1f909b1508303a4acdf2569859507d5a2fb0e41afb0df7aa6bca9ba9c c5799724618a7adc21d06e38ca9092ed589c567e72f8e03ac2c4b551c53fc321 c71e9288f40ec01f45f62cf009dfcde3b52f07849f6f5e03c7d8530cbab3bfaa cad2397452fbadc4cac15cd1e6486fdc6bf45f7997ce5cf871bdb63a3b843f03 cecba54780c1493443201600b1ae376e2f33a6a6c95793cb6cd19c80b9ad775f de295dc0bc9f0d5ca7588d3f9262c23de8a40572bda762668e2556cb544c6ff0 e05431a235bdb431961fc60889427ee04ff076a611ee5f60abecc2071eab50e2 e0c9233d1807c16de71f751932564b73c800e27f5082f7ac6a02116f8546cb5e e3bfa4fa1dc4464bbff2701eb0225fbbbaace5252c25ece32fe51448f688f1c4 ea4e3d037729d49783d4d50d0c3337ab903b373b6c593cf5b5092affba3ca40d f1ef0c239f313dbb4878bfeaa263cb3df4443c7c158b11b241b04d3b4f846a9a f311c223af219b239356bb674f0563793c92a2c1ab11ec80c09cde05d621bd76 f4100740b669a070eb58c3524fac5f4e3e32a433859f27deb1832f2137d2e92c fcc05611403d025c26351214a4247b8c70f2fe6ffe2f26dc0c141e91c2b3197c",
        "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
        "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
        "GPL-1.0": "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6",
        "GPL-2.0": "032737643400b8a1eb4381a7b0f04bab64565fc61bc38a9ddc86bae84e589b8a 0e3c9b43e4f6d8b515088a4f5a9c79cf376ce10848e835d84cb99780f9e0a0ee 0e6b0d8ae1640cddb38957b1a08b80e984c3f0eb62267c6ca3442ac53a559235 0fa03ab9efb7339ba7ec055badbcd4c8747feb45e27390643341815b99336f73 1184e278cea78de7f7db950972c8f7c41bd77b3376bf811aebcd40ae4ba8fc1c 1200b1df6780479d6d25fb4fe881e3b782659b6c8a006baf63d37ded5db04d75 13689d1c8b7e98bcd6549ec966fb2be92fd2f961b465235a6294cd5228c89e23 1e7396b1075ad6140193a59f0f9d31e9c800e81843ed1e3ac0e145439f532a6a 1eed5bb8057143e15ad16021f22c123bc877b4b31430127543f07e37eabcf7ba 20758c54904263de816b4596527d1c14f8261d208b65461f1969650ddb00e4d1 22e47a2082fe84f6c01937079a6d6d825bb4051ded6ba7ca8c350875f0910ef2 2a3896076326283f4b03bff1e05b43b2783bf0250f1d9bb75a1207a4d04758a7 2eac7ff4b592a52bd47833c3fb5de17429f9b20fb11514624c8d75d1df1852fb 2fcf4d7adb9885acd51e8f9696b02f111ea92edfa32115a1831e29c64b049df1 324d41c7c8d7ed28f16ce64200b2198aa3ddb6d446e216c3402cbf0802e0d8fb 33085e4c80c37e222fdfcdef93168531e7681f62650d54f24ad1aa582c2e7aa6 38ffab62bd28ed3342b63c910e010e26f434baafe102a70f142f584fe62cf6d8 3aa8cf9d18314dca5aaa8a1df336443977f73d3e7b37734aaef24948c1056c06 3b1b2da396e481a9acbf683147c6c6075eb59947e877c201b6461ecf231bf76e 3b6b57288000d1bdf7a25f4f059818b345ac75ed9fd8879a894035f4562a4c46 3c221d0193d6d3065abccbc694b0129fb864d7cf51e25ba8cead3daaa39d4011 3eededdb8113eaa8f60c09d1433d82277a8cfdeac96bbb4082778520ae0d9091 4343f7415042347e3f3d086098198c013d3cb3fa3e6a9753c6514b3184433dfe 43574b6c8e7c129d0635288a79047069d10f54745d070d1b0b77014b8a6c3a3d 43da9f94c3ac49dc793073a104da2872349b6116007f547a0c4ebb3a3b2b34a7 44e6c36201e6ee04609a810c385321eb4280cd8cd991302938caf270db908127 466c3bd42cfbcd9d73e63f4ae13b35e3cda438bcc09a08685eff8142ccc067c4 4a20cdf0234d3ca6e00b3c215604746448253eabde72b6aaf8aab5a8859293c5 4a77d0c9044241d8de0ef99bc6c4885385315544d52e7e161c7a8466895b6df0 501644c08233cf47980e985e4cb998c871a94b7a28bb1e131622a2d9e3a41c0c 519e3f2251344fc19368284384bc9de514429aeb785a742e4ebddb62d5a1c6f9 573451ceacde1aae2ec429aec7b2a2ebc2462a8f171d7c723bfc17e7b3d2a6b6 58b82332f2af14c6bbdb8da8ad3bf7a833c29c5859cd488f3e1a5fb19470eda8 58f3e38ddf96df9bcb434d1e54f0a6ac7430b40970c0c820c0860e08a0f47c6c 5c6484bd8b2159b5683e68b063aa3ff4c9d5c20be3f690f1ccd882ac3ed3d5bd 641347f945e234b88b0ed30d42c2887bd3081a3e98bc89a578d6466c83763cbc 650c477fe7d808845f1afd5358a586a5618709f8c4f2c23a50a35a7770b7a7b7 68722e673cdfbc8b1d37210d5a86645d67e920d3c8565e11084d9d2e04d3668d 6d77371182e2b075933125a00f83f7a236e52cbc09fb25957f674b834bd972db 6dd9b6aafb357a7cb26c07761dba88bd50e243ec3a63770c1392c4a9cf2a5a94 70f423f998c258444ea1dc4ec4f479fd61433acc57619cde9c017e85d5391456 72084d0fd4ba6a7334384d947bfa7ca0cf43cba884bc4288dcbf026a0bd9bd0f 77f0aca57b318d69268576f104b2b2ce95fe2e2958b478325d91769a039c41cb 7918010e8d00285c3ae111aa352676f35bbfafeea3580b40ec613128dd059971 79e1e3af9e199928991f9a02f8f885f192e621522f5a971de72684bccf208dc7 7dd8e501b188ea16ae7f2693c82734b443367dc2882fb0138387bc96bd270e0d 7e5fbb8cce53632629df04fdb23559c3cf2ac734dcbb43294429d0cbac203849 8176c67707fc6bef37884b06d97c211c12499cfda2a4ee3bb82a091c6327961e 84265609916410da3a8dd877cb11d46d8bcb375ff61596acc76fa0830b9d2b2b 855a5bd62f32434689025c4e7441168517847ab3e48a1e69ae8cf123d4651c0f 8654f5ca2a5051d59b39d4c26f5cd94d513a5c20960b27cf07633580026dcc25 88548052dc21ea586191d0d82599b8ce2adae1850ad10f93da39e8196fce1b18 895fe7fe6e1bbe570c1654ee0d7c2fcb91fc95e6f04297f4905911f9d011f771 89a84cfb33faea541bcc15c8963596a81398f7b844628c42988496daf71436ec 8b0ce0da9996bec98db1690f295764638da7dbba5d4daea106e29ff461de6d32 8decc8cd82d353feabea06468594cda4afaa60b693628ef312f8cc38c4892a42 8e2ad6a4cc6a72c86f1129666e63bdeedc8c8688d3cd57de2610c0bd1fb47773 8eab53a5a8cb7a0210b9d0a86e8318177d124fb1cc62d3eae67a51ea5ab85893 93d46923eb6ad11fd3ecbfdcfd65c80f504fa9fa4b1ed210c6b418f0a6e9445e 96358eebd99b46ef9e9e4ae423b3e0c0a130b4d3d222c9cb0dfa1b1a5f266f58 9e5821a013eb9e56288e5a972bd5d8b99da367adc8d0fed74101864ed86dfd69 9e78f577ecb7a0c908d8f800a7d6531cf701de9df5cc016aab39943002a66fd4 a094ef8ee507a9086da5cdb413f5b21c787c9f6036e5b79f3aa2d20ff66b5505 a3828db14273303de49351db2dff6e69a60cb992de93e5747f43be3d4ecf54a3 a63d258ac5334143c46bb793cc3f629ff75837da13386ccbf0aa638aec18cdb0 a6a8c9e7265ac074d5ae617bdb75ecd3b8ca142a192786827ba9dbb2527e58b6 aa0937f7fb0b833bf7e30d362a866db7a822875a3feb43f971abf8b962b6b51e ad9c0fcd7c24eb74d0f5b5b2a71eaf9aa12d200585433f457f0b67a666cdf4b8 ae02118b708a5855b7992c8c9a3eba4274fdf7e471fb1fd5ea9fb8e4c128152f b529442921d60cdb0741490c33be99f0a1cb878d46676a1b35412b3738762bc3 b7a12f302a14dfc504443bbe59c70b2a95496cdda167abd6f46024ddbb0dfd08 b82b20031fcaf0d67547e5670fb20119c2c26463d1e9ba868d9a02b1a893e1b4 b90ecbad37ca253c9a13a5be96d2581e7823e5552e995afdcb8e05709ae09f19 bd130017d447b2c20479e8059a5f53bfc02399d13130f07e25b8cb2ba95bb66f be7e89866c4cd332d2a03b87efaa3aa184ca7d9ff6fbb7df7584617eff2da41f c2fd5dfa3b81e6f57b668628802447e1d0c14af03c70579e77b475d05517d455 c66cd58a65e5b86f50966917195bd26cb99cd81349620b4a931b0bdcb565d5a6 c6cb12264d55216fe9dc4d5387c43fdbf3931cbaac644740acd4e548f071f7f0 c7efa6f377e506e4f42ae1f7f01f2a0e4548ae82b1a09b9877f55dd46b96ba19 cc09670a0aa7131411dc3c350fdef9a62d7f338080b0e1abc2a62954f894f888 ccb58b8957cc99e3479f1f30ab3a5fc2a9dd1ead96e857f2fce5b1c22296f181 d45dfe7c277ed56e8c8a09316708a94546664eee68d617bf70451171fa2a6b68 d7a92882cdb451a5b6904f86aa9ce53e439c6d9a5df94cac741a8a6f65747931 da51ea4ec4e885c2a2df5a8d7a3cf02a76ea307a00736ba535c333185e9b8355 dd6d28e22a4cbe14710f187812533a98cbad009383a036beabc7bc4e93bd3cac e33faea19010e826c3b259a951253a564ee67c58af8e38ddb58f49d2fc272857 e7d1db55396811fd22b22fe393f45522b28451fc3d35020cd42878e1d4999297 e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1 e9b4c2a0def0fa21fcebdd5676d91852d6044948efbea9ae36ced92f024d9907 e9b6152068e476d03125852f848e24cc22df16ad8942bbeafec31e5c933c4f77 ec44faca801bee5730d7ff0274536cd08268f0600b4a94a6247362b84301d571 ed27d0af7b3d628ebf437e73767f10f9fb4b968579356cbbb63254defa16ebf4 ee767ef3a599b72320b8b8b2bc3668ad48821d4c817f69d9335b81ce11cfe787 eec2bbeada27b4706fa93a3abfb47ece5b507b2eae2997d3cada3aa5d6183147 ef6e4e73a100bf47cda7e29e256b4965a7c3b4a7221c065d00930f064c1098f8 f0f4264bb8146826cff28bdc4d603c3be9fc519b4c07e4fe1ed97127cf59cabf f4f719187c848093bb86d7db9807eb6987d9e6887c2ff72e1bf8a16a3c56bbc5 fb5133fd2efac20cee7830fac2e5bef180411361fb4dea546940d5c0aa3cd887 fec8ea1d8a9928155394283e680f94bc9a9905eb7451af81611206ce428d78a9 ff23542093db6c71ca662b65c39643e4969337fb41d64bf75d9404a245d66a84",
        "GPL-3.0": "0027a6d3a7f0d42ff1c7ab567e3f24736fc7747019368710756f0c07d43c1db4 011f4290c3dee41f9e76fd27831d7682faee344e94ecab8764318436d65bf168 0216c90497d603c63307cb2e64d455491e603b7d41bc88f37f2d2e449d0092c4 023cc106255f97da3fcf1c5d04d87261b70ffe4b0942282b0c7f3a636788c6c8 0365da74414f905e23257932b83bd32a070d0d5b575d3592f39ee64cd3186904 0a85ab25a52f42a58c2cc4bf76b4808eb5d0505467f60ad614ac4d676f443478 1008131aa427bdc58b45eaeec58cc6bc62f7261d1c13a00e727c8328abad20ff 1ada51e8c390ffa1cf47dfa90dd651ea2cd64a9df1f8f1bed26afbb11d745e9e 1b26a2c84777f371869c32827b0d758c55ef0cd266cdd3a32f0cefaa27f9bd32 1eee02869546a9bafb0b5fb45a8bd8ed16ed91e44f77c3f4cb91df51dd276dc4 200477b64408ecfaa0afd908e5e744e7759db0b9e972bf682bf25ccae4c72c4e 2077c766a6d19897a743f0f83f5d18b8e530eaf0fac2f3f338ddb4573471f2a2 20c06dec33d00f2616af37fe3f5ebff086b05cde790fd9b9166b47a21a0973cc 23f82c412d81ca1deb2156673e1966634f88e62245450577a3b185ae42f86d8e 26f53f9da9efb72933aec2474d748838f81e91e15f972a1cbaf46f627bb5d252 270bc2a5541dabb5dc8339b22e925366f1b88e9b34b00f4435f8e987dc0e0e10 279c0044a483208feecd624e502959c7f751fec499019c0f4bf263487acf4b78 2c97d75326d126ca10e7bf753bd69aada3b1ad61639c48d6a3953cbeee849d72 30877bdcd9dcf51bb2c6055c4c9a3fbb084141b677b7cccccb6b8c4dd6a467d7 313212ac6d4f21830c0257e02f1a1cf4a61915bfd25264b6f1778f3455c99b6e 33935eaa950609a0395b18cd64bc18373b4cff0995ed6976f247f3b93d6aa170 3673fb3ad4e1229282f40743252de63268e2c8966ffd0278a2df1d3e5761c14c 37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5 39272a093cfeebca2f41b59a297b28a95e60106ca1aeb5236a3f692d23d137ed 39e6a1b827784839737d3fb22f256aa7b5a32b848fbeb9e2d943d86a26bfe41e 3d3a6143f88113ae90e20dc5916be1de1c7fce317419c04e5e2a90eecee69d4e 3f5f817483efbffb26e869e09a7c038be5cfefaee344419606b463e6909d08da 41b2221e36556728e3ba4382492872e30166ff26c059f13d14fc8e251f8a5a11 424e999fbd14c448a37063abe90ab2e69815f2d25fb3420504c654d2da1ac150 42808733b1c8eff348e10e2643b5f231fa5a1b8f9a0d8430f6d01a2a8bf1e690 436cefc9a35d53844832b5478cfde278703ebca91d21ae02cd3e71105d6fbdf5 4460e271210222404ad37f6000a7808a4aca33e0ad0b643d20a2d56dfcfab96e 473f69a037c1f4824617dbf0b4a8d7df82b6d372509e57752820c5ceb9bfa8a6 47e104adf06be2f6da72027568c46d882ef29ffe64f7975c717555e4461bef53 4f19791d197cbc9685ea4137ce05d0f40a18beb96350b72cf369849a81faef54 500c45c23543213e5efdc82d7d699aa6e714a2f3156c5ac44dce6500a86b6d25 525d3510a081a6041b49e2643ab4bf93f1da53372c62c85b660cdada9468cd3b 5382e5029d2b486abfc73239bf4dac3ed7ee430625b0a1bc1029a91d10ecd603 57ee8c0168e190b715010c26d362c9db8c8100d179aa1a9dbcc3e0b86d038f46 5d4f9ffe30097bfca39db2e19167e20ccb0cf4a5d90cd9dec69c4f4248d33ecf 5e0605f99fe8e757b682152c7aff5b68e73bb31cbe41e66ee2c91e5af4239cd2 605cf3f4c2f3def56145bbd7ffbffb330efd82c7737f89426ef3cd85bf3766de 60d6cec3037f77e9abb91c976601c6c2091c33e9921e5a073c2078951c95e4f6 61bc7038b951946dcb74f4ec307ec8e3eca313102aefade70341d5d363e72f32 62b2ee53c71c14a3de093131238dba64b8686f08f7c919d263022044fe82d29c 638805056cbb170c2e4af94d0104abb62b60e7a808b28067f90eb3cfa77bea9a 640db35b2db63cc410457298ad2d4308ea7d2531c36ac5ace99fc89080570440 643fa804c1ebb4398f58cba8ff7c6a7449359b8afd12c1e8291a30fb89d60d83 659901cacf8fbb72256b025eb429e9154d62c3a733cf9fe195debc51242a773f 659a034e3baa379f67c9330164aaa6000509c91e613e233f2a7108549c310c2a 66e5f6d46a4e999b758dae78757526b88a3370bd7c40f7ea2edafb08585dac60 72a3bbd26478f6adca2cec1ae60ee2815a0cf10905a3705c8c5acc1f4bd5651a 76950412c1bd0b6cdeb26d6c808fff8f18a6cce9898affe596d4606e507fa226 7e47f1eb42cafc38bfd434eaf59bbdc05af852a2d69d7282ad49d1d63066488c 7e82f9fbedfce1e37cf8a154c2ecf2b91774516f5da1d03f3b92e260ccbbd299 7f809c28c4d1132065aff4b2643bdc4372d6269a2a15f1d0b06e286ca5154d1a 81273d507b34a6c6bc3737ba0a71bb031fc53e008181e9e18a8aa5c443260e46 86cc14fde51d648e1d084ecc39341eefd11fedf263aba490c5b70924ca271986 874010980006a086f4e3749aba7073d172a62eaedad3edbaf1e03ba068d59aa0 8b3e1b3d745efafc0414b06ce0f567e09fb3f8d3ff1199580b9d4726d5bb440e 8ddd992786937d2aba38a3b2ac7d5e4c127f844dc4401af462f9e9b362d5955b 8ef00de43342d5b4b106ab7b4463c09a19cf95a70417f35442ad28a185865938 932fbf910a24773cd4f031dc115060e92cec961cb1a5a78a2d71ccba8ba1bd32 93e57b70ea9ab0329f67a115bfc612fd334a8bc00bad95f49ff05d5d60c7c8b1 99775ef9631e47ab511f5afaa04a487571aa7003524de0581688d64b490bc14c 9df528d39224d62bf079780444bc7608c972b1a42556ebcda40d62732e774957 a3012ae4b445239a840468f27d95d42b113d120c3c602c6c25eb2ed09f9f3de0 a3eb01cdc52465686acab3b1f0e8e72956056bd20d7d2c9dd821a4c62f9801e6 a5026a4fd411bdcce3e28a11a380079c91251ed9ee6b49adb65249e5350b540a a7cfb3d366d34cae9085fed8590a5463bbf7c5e292980b2060b378867bfa14ef a7d312719151b4d0f609fb6fade144037b4569da2544baa7049b782110bf1686 a940a9e0e9d3686594620bc077b20f43d92a9439f42200d79ebff8416a3cf474 a940c6b68caaa0db63be86df91a7a8e92dcb139671d46fac1ae78df352e6ba39 aedbcf8b44617b453ff485069ecff2abbdb71aada8307a6014933351d8dad62f b14f10adead2f5978a19aa391eec349e10473ec4fd2abfbe693d3ad3a81bde00 b396fa29017a7cd668c819a12f245b9d1ee78e2f40f1b930ba8f3ab0feb54d11 b7c5b8d5cc03de340beafc17f2de8db727f8202087fd4da7e0d9e7a377a97271 bb01c0d5876cabc7590a56077c5d0459442e5ecc545f7bb37af4ccd93fad6196 bf7aa8a8497e60d2ca37f349ea796baaaf6027a4cf333ed91b6fe03b3714e7ad c083863f86cbc8717a85a4abe697dab6da43c38e3ac4d27582c05c2696ed0bd6 ca46f100b024dab49928579367a2be313cc58016b1daca389d0634a7f4f8ff18 cff70048d543f71290923a69d504f2407c3c6a9665cf7508807b3aa61a104816 d1c035f3fab1ce18680aa9b08565855e113a3caed951d3142fc678399b961445 d542cf57481e11c860408db876fd18cbadc4f30b961e94757d642386c3d22b0c d620439ea404ea7fb1c8232accfe4e5b5ef8f37840d16a4704f603f2fbe5bc44 d8b38b6fdaea6cf6cd1dc5c13bd4a558c4859530213c67f752e62a08f25cde48 da1dfa1ddfa64036b8c72fdfb703e1503f1ca8d851891abd21a4231f5f38b9b6 dcb0debacd4dd91ce1be362274d069142996e1491920d813401f17288842fcd5 e68bf39269f24b62319a511023c3c61b94231eca17e499b1e77e9d28218b328d e8ff8d7b35615d61ebe01de365b0622f95a91b2741ad6149b7b16601e701c5b9 ea007816027dd7ad7cc516fb1936d9d0e3a3fe3c6dc3c63b709f4415d1f0ebfa ef0a249e191ec3b4c89064ec586fa07bebd21dacd0e635ef240db444879c3db1 efc4caf71bf5f7ed42cf8bd4661412f536099a08362f6d434960c4e831242514 f04f37ce999f0a795f06cafa06fcba649ff0bd57439f3a7a4786db82eadfef63 f0924081256bd8647723b86af21892567954164d20fd908a7b2622b6fe688968 f259f79d192e6acdbd4955dc075049b97003b922f1c0825eea53ba5be16172b5 f547a4bfba9e444c80d7dad05ce6bc9a81f8f93bb146bf921b3b57e36fb7edf0 f83e36c6283c237b17ce06d03461e266e1d941565b65ed923d488d60fe346fcf f9702df602fcb661c56a615e11a667753335b03c0ed0fb7e4f2834bad12b8b39 fb175210d04b5b6ff57861c45c0bfc9457dc632d4adc35794bcd9a1b056926f2",
        "ISC": "0ddff3eb02f6a6fad4061291fdaf6554ba53aed688b11dd30f1f4a66f8e52055 12bbab2f7c746f45f43e0a304423e25d63afb65690f42b81fd795f65109d1489 16036757c6ac99371da3e82c00c06ead24a8e5e4d3fb70e0d3b37b8110c3bd84 215fca0fc8e5fd2663432004b596066461d94bf24dc720b62d70268daa51212e 217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a 271456125927683c614b2b2f1a7a9d48eb8f69c813a2bb3d43a71b55aabc1d9a 2785847ab9fda3870c8cc2417193faab00efd14b78361ff2db72cbed3aec65ad 280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29 28a1de8f0aca4db25c49afc59a1c979a9fdfa5aab11e491b6d4456ebfaf28a9a 355af2c28f2bf0a8db98bc7d7c788da0a376e41b36cb45d9916e331bcfafb02f 40ef63c0f11f64a095bc8234a3f38fa596602c5740e7f4b3d21a9feb5020ed78 495def4cde05dd7818dcdf4c2a1b6ca483fba3011598f594c9e20faa2160690a 65c41f459cc87bee1340ed72ae43d418235b4a3e5c9f196be8b2d086a7913b1c 6e8729dcc3e0e1d81ef8f734b518bc82b377874ff715f92ee6bffc9cc75c52f3 7b13a220415ee391a6bfce8c31d93b32ae056bbdad0c26b456d9f8b569cbad94 8345d8f27e9be418f0d5181d3ca4bb44c0a70b83b9434661a731dd925239d9c8 8a525dac5381b7aa6885fdb56da5d2224193b8bf5a9124d2e8dad2fe391c1090 9439e0932fd7566bd46c65bc257663f936f4f0890acff81af9af15fbcf94ac86 98ed034e247caac2061b4d6cd30404f9a06f3204afc63f6aee797cede7c05f2f 9a7910ceeb40fdb737b12e25df832283f3a6982e48e108ff18da1fd3ea360dc3 adc57f08417ed17a8ab63cb2d6aa8a9d4a7ccc34008f14f335a1ec54b6800d95 c0a59e6fe3c8940892435445d0960a02620d7b52f67803bef049b58b5294a76a c3720988c0ccebd5493728c17f98bae3d0da83b4d58c02070d57f339951fee1f d0a46b711003fa64af35e534578d9f833ba20250bacd25291672c813103c1d33 e6b63a97d131ec86d3c78ed050a318d3f26d4e2a931298c84977cc9505318b21 ed6e54e2ce452574e03afd562dd5f61916f2d7d1b427ec83eea72247409c6464 f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee f1f676cce271ad2eac54f8b6d0a01357dcd83db00b3e129751da3bb1ee65ac74",
        "LGPL-2.0": "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d",
        "LGPL-2.1": "0016d50181d8d1dbf1ae66589bb41743df8c8938a300ef7abed9edb5a1ff8735 00b29ddb51cc9957fee536683029a486c4b9c1e2a84a550907cde7fc5f5a4b1d 0bce234000d3145ee6b4de5386dbd60c0bd16f3ec85418563c56bef45b9c6969 134585d5aacf9e325a1248950269b9079cfd1852b71a1b9ccf6ab2aa7fb6f412 16eef0e425e81d04f1fcb2e7c1aac2e3a2297041dc10c559efc582e7b4984969 17f3e84e67346266c4e8167a626c254f811ee1d36aa60a4f9815bb99c42e463e 18b23584aac11dcff065a29f20e36f459068ef2eea53ba959211f1d182813086 1b3c21550ae41cb5312517de9490181a02132610b496bcd64a3233b0af6e4c7f 1ba1f24b2de7da8b5f09638eaea2e525466700cf94fcf92e2cd0bf8a6708b0fa 1e4ffd92fc3bfecbe1350fca39c648cdcab72b1d81d795057a4bb08736ad70bd 3f6d02e7c3c70ed4b168b5f08c5a19b3ae0d98a73028cfcad74a8c7f8b7d0527 3fe5eaac43810263514bfc92682972b047871be5e56494dea72b0e9cb1c355ef 495af977925ff2a723771b7a3fa522059e7a1ff3523a5a92b48c2999ebf0c45a 4f2b4a62f265e574585774840840a17aaf78246c300a167d3f3c72998a6153fd 5278f6f7ac1bdf8f104b98b4af13a995290723f9d01e6fe7a82b04a5c11eb958 53306bcb56ec99bd10cf2ac428c45fadae9f4d1025a803b103336297021a60d2 586e1b6036cdd6ebbb688d10a9a597cde95663be894fe39cda02cd968463fd26 5f0332155297ef188155f77af8d27fc4bc156b073c4043485c22a6341520578d 618ba2d56d1e1d7204644b8066aeb4a5490dd0af5bec83ab1a69fc10ee5207fd 62fe711d73b38574d2ccbf6c0fd6ad41e543369ab6780bc3000203290933db35 73ada9437d3425317c058ac3ca6582bac6b3ba5a7bf219ffacfbd6ede5ac8526 83666979a3633ed179388b6a6ae53c91468407e088b86366b1bd6f7fe17965b5 897a1bbf4e2117b73e15f66b328b1c085dd06c667a2a3f70296c4904e22d62e9 8d790b9b9c71f8ece27859acf5b456e90ad9332a578b8eaf5db783c4623b47a9 8ef29f7ceae179835f69369b48873938e2ee17c325560c887ec408856e4336b7 99358449af0428fa57e3265cd417dc7e56456b83129e0e69c3c3950dc6efce99 a211008fbe2ffdccd726bfbfbd98a5a855a49a8a71def176b45d357065c64560 a3927353e4424bd24412fb99d1ca2fd14232314ab37134a96869530aed5d55b1 a6696620e8c71ce566e5a689d837b60aa8926d7c8198737255f52bc4651306bf a860127a2ff0005b04d90052e1f9172ce7db1b8d534d137dc79aef7e0181260f aaf2584f402e966e4b3dc11a4bbc73d45ec34b546635b46d143403da10b46c81 b018d4cebe7e04a69e1599a390cd45c3633a80094df6869f18e3db7af2f9c8de b201afa0f3f5740fc845bab05ebe709852392ffce724cacce5211b7bd076c685 b3319a919cec320f041ab60134ab139d0097907a1b72ad31e434f03e343a9f82 b4c9138abdf2bff9e518e6ecf59ce4aee00f382e3000c2e4065fdd5233d11816 b5d97d4736945b47a816e228c0b6ef29604a91c433735b718e7fa88d144565eb bb5b6deb0d6a6c5902b897caff33ce18787b6e385ddeef6bb0e0ead930fda4b3 beafe6cf5dc6bb50abd05b53c111f807de1f58443b2b3133763695e058d859b9 c30d53106c22de2014d46dee0e3e5d33a25e01fa58b4c2e0f797360f3d8a50a7 ca79c92cb95c0e9378856aeee0bc8b3a36c5fb47aebf896297adaf3bfc5ae714 ce311579a7cafb04a272a6de5d0545f47cd3486d37b868e9af4c563c613b9ade d28edf6dab2418f8bdc3c3c96ad46b8b0264c4818ee23843fc14229664aad697 d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f d7fd9fe036e8f274f14a8d6246284daff913551896bd7154d0b9eccd00b3aa5e d9285e1dc7e6759b2665b4fbff85e0fca026b57434ac555299d647d26169baaa d97e9ad3ce19921f117ce0f59d840bec13c0cee2e5617950b54fea78dbfad64d db8dfa3f1a1212dae96efbb64e0a64ff090bd250171ba8918d04f270c903f33d dc3c47e57053d1a69429474321109cf10281533c4437f6dd0eb6fa8cb5885474 ece46bfb225207feb73112045381d184c8cbad2b845101071406c9e090ce2cc9 f88e5ef204af60b2bf8131a17eeb9fa406cd38ac81f0250904374e4be48cc231 ff524229957c23b4b27bb36181fd5af470b452529b10632ecc3f2f1ca6be30ee ff92d6b256b035b66130b31f0bf8ba7edcb8efc242d03547e4ce162e4e4f802d",
        "LGPL-3.0": "0146d21f1153734b7c70af32365d87713f7c6f2b67b4b2098384fbc6cef85ae2 037a8eec8d8f8e14e1279d8702fbe19c68a1243c588a9d620d57f8cbc0bd9256 189eb77c742d49e533c05234662eb00bcc1138ce8dbced0fe98b796bdd5c420b 1ba9d7a9d6dcdb5e0229f07ebae34251b3584f0a99927edccdd07058937da85b 1c8cacc9dcfb027dcbae9f6dc247cb4605d805a4e360f50744fbbc0b8ca139f3 1d91332df9af693b599896c21d84a1a2c26cea19e6c0b5ae9d3bf760ba7ee9de 20da21fff5369833e89865dd71138c3bbeca0f3bf76b96fd82fc6f952f483885 26352cf6c6e9ebcaf50fd3ea46bc6b7377d1e3c47b317521f199de08784d014d 29b5fe57732048d1b5148ed0a8af208611e5942de3f9c7975f527a57a8b42387 2c675757a3ce3f6d6f96b3020f13280cc9ac8eb22e1b0a06abd510cb88393628 2d7c54d1559115627fc7d2f7060f348725bcf86bf292f526c9d45bc20d405485 331a7e15897a0bc0437547723ac5666b2fbf8b3842c6769f9fb017c15273d128 3a67652e446baa0ded97532afa01d8ddcde2006a146b882e9ccdd1e66427a016 43f078e30e453cf315f17c13c9fc6127350db17d21326caa616d925fcd97bcdd 45775d5f49ca53598e694791fc5863b1e9798676c46cf09a2a3086beaef43e3b 45adc89be8a4836f8a2968630184a4905190dadddbe0e3a4c88c01ccc6ec7820 4b3dfa11bafb259d9a4d64245d3405333ef36c1a6b927e6547f00bac634d4dc1 4e5077df4ee9d81f1beff35e6054e6f88124dc1bc19482731bf653b13d14d8ea 532f2c164cbb276a07e68d3882c19d633d690a8867540d83cc97035a800387b5 547a0f94e8ba2b3c372d2ea17c76fe0c8cdaef0c7d72101aeac32412c9c74b7a 558cbe90937f7e35af535eedf1f7e1aeec91c38588fe8bfe3346d92119eb9d22 6037efc3277ea30a2e704f6f6bfa6c516a47220e7830f1d28c10d13419459edb 6afdee002e3dd70add076d4e512bd85f004f28babfdac07945a9d10a8d3025c4 6b27fb4d8cf2e0b56af8d4a8e00f96277bfb953998e269607e2c3d62d022c2a0 6ccb9d9de20ed029515f335e83fa783d2f7395187e52a8925d358cb153134ffd 722b18a68c772c52059d4af832d8731c03e4995913bd573d166ff3641c413518 73e39d544f7a2767e457a1eaf8e4edb096b8cf7f931e76a20515c68b0d77d2cd 7b8479609d408eaeb0bb7c5ee8f2a492549ac680063f6f85a2b87b3967d64ef3 7bab9f1f0f7d2bd177be1f339939891746b03aa509b08493c610e358eca0a8e3 7f0a70cfd8e4551d1544fc28bc95db1c35aab62cd3e576f27cf69da4841aa8e0 8c6800cead16219eed09ab1d9d954095a94116035ef572af4e22a4106e24585d 8db51a51c58f1a35acb7cfd50bb35b6f564984f72b14d8dbba01ca57f71085db 91d5ee6967c7ce5bc7ce027685d1577babae97af3551cc08c805803bfbaa9bb2 980cc775a502ef5664e72f0c39f8e2ea5a33f3f7d58052fc92d6ac81f60667ef 9bc02216565c3d8d12bda7f74a1dae565c72c472345d5b58731cf7e3c5ffd7b6 9cd926d4d8f0dc023008c8df83ba1dfc959e3a4c7da054d8b07403efeddb5b70 a2f69692c0ac4a63651c05099ad21e5eae26c89f79835a26219ed356ddb2fd08 a5ca0a4c1a853466b19aec5bd8e6a7baa9e61394951d1487755a358e9ef2122f aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be b5c73a68be74992dd70805a56055625d1d3f1f1a91dca670a6063a37f0f18a33 b9bf55d944fe5ec51aa67b1d148fa58e883fa66d1c424921e988fba25fc49241 c07d653f6f8d349ca18db22d5117cd4f51a8160c020417f1fa2797a40b5e22d6 cc225bc09596911db65c99bd1bbb706d1470b52eef1f18ca03c12677ad11f341 cea0b1de51dd25156b8ba1fdec3aa3f6ae1da8d988e34df4cb5258f288a4e46b d0a6772386fe94c3d424c87caf72c5b2a8ba1d26a75fad10f36a53b432c1f31c d571afefb29c4e3d444364940bf13ccf016c6ba7ad564e102fe61adb7040d04f df10b2f88d91079a8c7d47cb2f83bdd3b75e59f2d796e02142db6c9fc14c451b e110ed1dcf027b1490de9771db2c0ff0385965c5d21af3c243acf3670b33867c e7c536dbabe7fcfe1e37debba92da5c49780d32f6c4c4f9110318fdb08340119 f1343619b682c8c1212e92b7b0b537637d3eace527556cb3951faaaedbf41058 f5a3732ee32c1419f260aafcce78dda7d673463aec5f47ab3320c3f2876796a3 fbc86b0749a73e74a6079a599ca3e2f32d77128764cc66d8347880dacd6b5710",
        "MIT": "00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541 06399b2389a4326945a547a9adbda773566c9b3ae44cbc37aca674c0fd049109 0c219e88bd8e882c932808efc8d11ad4753a9247b867ef2ad8c79c43c630ed82 0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c 108c3590f11eed18307fa9cc8328fdb7e0600df4a9583aa679f54fae6d4297ef 123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940 27afd809b782ccf7ec52b0da2246c9521ec7c37adbd411f5266c416d820bf3b1 2df4c2afd9b04c2f4d83966840cdb15ef41eed73534fc8d72dd0e579320439f6 33d8099a8ce10159d0922dc316e8f7aeaa8d0df661017392e10553876623f6dc 35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164 420728524dd73e2886eda4d63b648f72409e7d1dd5d804feb32eeff60a56c77e 46b11d2a3432060d1174152e7f7ae3f5a7f4cf974cdfad57a03dd1f03ebced02 4a86d994b8ef6dc339053fd39b06f50497fb126c1970981d08404ceb8bdf6c72 4de0e8b7f4cb46fc5ca6ce838ffa67eab373d412f5636ccda9dd08fa8d63caed 5132930c3be9a6e5b52a500edafc2863763117e20a099e0b07c7e6b331d2af5c 52fc8ebdc3096d340da6d27296d33fd4eda745638fc87a662e5734326dfdd3fa 59b50cccc807c7de9506e98b6aa0127e911ee66e1bc3cc92a9ce89b39d3d83a0 5abd24af0d6ebc64fb475fb1b84a47e0aaca9bceb4750a80cc8bb79cc4bec0e7 5ff236aff60520c2123b13e0f4826f814362f4a7b2a45d309405af19e0526be3 6574b7ebe0cb585e9b2f2c05d1e04a3181922d9bf36edf6c9f6a3cba7bac1564 67574122259e9d07c36e13bfbf6eca940d2e42b62d80f507c00fa7542b3b2580 6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f 6c387cad3f009dcddefac3694d06184573fe5e6de74bc5f014477b95b9e601b5 6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127 6e1806bcb91007639aa7d89ddb7e7c32790a6b42e362dbe90957dead5c10c915 71d5290b8a80a7e42b0c2e89d44af17883c2e045330d60b8eace4de73400c1e9 8236bb167c00317d6ed342a5205589e7802d8691f447f2a4cc94e6dea5269486 85bb9fc88a2d7168487f921ac86f33e63d297f1f914bf26cb0e338d532217556 8bb1131b2c47410aab10fbd4427b90f1881eecbbd6990c78c78afa666254b019 931577beda9be73e38ed5dbba32462164e190bc522089069b79ed2df5251a060 9a3264f947c6492fc24751e0fa72d753768535fa84f39c539f59161bff01e35f 9a46d7ac13a0001ef11761e5cb34b82d741b7c3c74615216031bcd32ef5cadd5 a85eae3d4348c503f4bf7cc0fa6b161d3e56c5ddb85bcaf5475e5f7ae44632af a8e4d2cbbc355f7181c068db27aa70905f27d710f5d46ceb74dc9fa8d8e5d70f abe2f2808d14ca5434c076c9ac9610c6b846909a26ffe3b013561a9cee25d4fd ae7c07a2541a2befbfc7ec7f389eb113f1fec11d5ad30b0526b92a5d0ce079c8 b1458b769dcba07ece140d7743b6300bc26aa6e3f2ed0f8f7d4b6e409c030c99 b14613c9f068d4a59a536d2fb3cd78d3a53ecdb224f8c3d701a8f2d256a2b232 b20cdfa1da997d0a5aa8b9b483c33f8b44bb3b9cb0e456bad2ab3d45b095716f bdb517b0a6a2b93fa94c03cfc9ccb8997e00c04ac984c4bbad2b974a9995b083 be8d656f12378b83a301c5d1a604058be91eec57e60a25192d0f1fc17b5443a5 bf637265454fa1bb19e93b82695ec6f4ef7cfe2a7c742cf53ab79facb4d91c0c c4f0da973057a733d9707360b93b59138371470a7bc38f47fc945556a9dd171e cd2a2682b02522be0d1e1fbf00c18938aed94f6bdfea810bb4fce9b995daeae3 cda54cc2658b339ddec549cd69f352e1a2e95d227711470c076bd2d3137a55a4 cf315ba1a16b0d4bd5b72b3dc9a107223f808a5f495b7deaef868034171dd3c2 d0ea95500dab7ec741813309b59a55e8f2cc369e510ca48a7914d5754be1c5d8 d70ffd6b123211c9f750d8f61ab6188ed74e0ac1671477af6220e983238a3b44 e7ef20201bd4dd046aa64b26ff84c124d9ff1144ff5469382daa27b74f3a6cc1 e85c0b40477261fdcfdbc8fab1db84af55e04f0a36a890fd3dc4b7ad9a622361 f191f5007d00f1b971cf7dc8c5a881b6037eb2ba7936bb5f72c7c9693041819a ff5569101dd9b6257b817501484ff553c5b039b664fc4b2a45d93feaf4ba0b23 ffc0494f42303aa47d70f5edb0c1d104a3759503fe8f93b25b9353a06fd295c4",
        "MPL-1.1": "c79a43890898fa82523112bbaa333007e51067add616404aa40df8240afd1f57",
        "MPL-2.0": "099fd9bd5afff271cd4b711eacdae527f46a0fdcd036e2efc235008f81795e0a 1255329cb67cfb0950f79e3dd6123718303fde3db883231c4706c26b49085ad9 19c474949a8825004c5e85a5600cedfd121a8b6d78d6e3a96d2efa5869659f66 1e036d9a102229a227daa2fdea438183761312752981d94b588a1e847ab6ee8b 29c7c75ad50ba40a3e7eff1e15b6027d574355c9bd55b15572d2c21caf319e83 328bb4e5ece4143babeff434d4479e1983a9e281348e397b0fd109de5fec31a1 34a7175ef7667f7638aa6fc7b337644c62ad4fc9a8bf43e23b294331f93a25b1 39a79e400f6b6fc0b30fc8b2e85534bb1715dc6fd7cccac3e89ec7ba002cda93 3ded96548a2f23ae50f118eebb6da8b15fc216f9f0e31e8d057ff1013a5d1eca 3e71303637a4a041d73b6c459ca3728cb62aef31b4412b69c206709f56afd05b 41cab5fdbd04ee105418e44f76747989ebd0f94618ebb702dffb8bfd521ede1f 46836d49bd3e728937cac4957b3e7a9733eeeaaca69fd63180cd74d2264bc429 53d77f9ffb410bfd5f81f37db3cc8bdc5218ba5d72fed3f15d381770f1f13822 58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15 5bff5d09a21459dd93684a5318404e5aada3e39ec33fe8050a74a119f3fc31dc 661111e9f08ccb2dc701a13b5c9f21dbc54441ac49a6ae1f7b2279b1d64df9f3 6d3dced099c8abd2e4d8f4f7a7333130a339b5d87a504eb17145ea0dde4b564a 6e989b9984fc02c50703096ba02c62f22a6a38add7e12dfcfda8f4e23a96583b 75010f6b7db4d8c5cecf869a9ac489a4637e2c39ad2f3ca55d798b8a68733b0a 76af8456cf3c6461f0af1f45d39de264d3d1b81d5af7eb7901ffa3cdf7fcfad9 78e1d1023feadce5a620317a97246e8d50044db082bc20e640442ac4f43a18de 7b97ea52bb2c34b47b08de53210b0f6e8328dcf62715a9755800023d6b2fc722 7fc5b5591e8ac1b24f73727444662edc241e7b269960c4a4c77fceb854a560e0 894aca32b7f7308286ac8977bb23aebffbbc10105b5dc136809af98818b1b26e 8fc960817f248b8a297b52dabde481d99d09fc38d13bdc9f11891e5e7a18cf0b 93d500887139e473740a7cc680a6f8d4f697fe79d33579b8a71dc548af70a2f9 97740b0072f5d083927f2034b4449c6fbf1149d123d93a55eb0bc592e6e0d6fe 98ac34a5bd186b4b0bf0dea38c3e162e0d91bc72663994ab1cf7bc1308c8d8ca 9d299cc532b9868f3f8a9efd71918375cf44ec4a9d5a17b34c5d81da4f0b7096 9e666d95d5838bc07bf588da3bfc6bf698efd95ef50661d93ff1d0946ce971e5 9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56 a87342a42c6764ea6cd4d4f5b57841cb0ace93c0cd11b9c211abba472dc79b18 aa15e10c1a801f9803b7c84f9efcf83fbf315bbe428dae3e9a9ef99b8ecba233 afebeca7dea72ae6f3a22d3030ab0a9568f689ec1ef42299593237422a5cf0fc b31df0a10ffb8351677441e2eac393a3c3328b6afb7b7243088e453a99201bda b4db99a5d1a6a2cb3bb213cbf0e139a41354c47277e982e8dc40231a5f48cec9 b62fd5bd2f95e77a0fcd39e7590a1ccc3efe0a3937fdc87014d6d2c040673a87 bd18b5b2421fa27873ed0fa503e07343c2c1b2eedcbedfabce9d3d960c0a79b9 c1504ff670edc80467cde39361aef2cc2fd7ebcedd7f67b509f87adf64e40962 ca74b40aa881907d4be921a037e8a7db78b192f8517413bf2581c23d852d8269 cae674b970f61ca56f34714e02be9e4aed7f16b7accda61cd8b31581bb2c8372 cde69242db332ef5dd1f0001b15939b308b79847d5a4ffcea804e2f1b0d02f02 d2c1969349f00647b0e3871fc5a542e1ed33569b9f0571e3d638cda93dfb795c d46b909e5ca8efc2b353a90393958181f3bdd2d4aa7ad0c97b08b628509c1f35 d8b8673961a7e52105fcd3c7d62f6aa7c8b00fb63e083fdbf2a6f6e214b648b0 d952418f696290ace2a6614f910121014d7c188658a7e3bee40d5f1d274ef1d0 ec234836a124d563299c4d27ea1f80cc6a5b5197aa1ea69d60791a9a45d66a4b f267d3e60d176b0c4acc47c0b10691579bd2bf06c3ca2cd79010a0df62ce64ca f66536b0ef0439c2f15c77412c845f49a8375f455bb649f28d57f8a0e982d327 f9c6d9096d3cf5f357c714c248e34b296a765f32cb02842997f58f4aa8bb821f",
        "Unlicense": "339f3c8f5c3ec70cf6d0dfaefc2628853335a65da46668dd79a8fa6a8e4157a3 37e93ce5c666cc47829db027f5b4b821f5acbd0e8a7da288f0f97aa705099f70 49edfd5636cece7dcde0ebacd4849356aa852a69833e2fb4a948392f20b83188 4a026c8ec8adeefc80a3787e1df7c3912795a70f810d2c174215acac4457d949 4e40d525497ebfb69bc9a05338d5c137d3b4d49c6b84cf7403d6f2ea2d505a1c 4e4a14653615384fbde1159ab26f714489017d0fada2237d9df5c979a538c7bc 56b04c6c1008a5ed2f90c6a49c16a83bb7eaefb5ac6591adae0096cd07785d2c 5be53595f45474fb8afb8a3bc05089d63fa403925524b335887085ce36e6c143 6528d6686ebf3209c4bfcd2738647c191373b2ddf505ff1efc9898d8431bd7a2 67e3ec65c6f75c4f4f2597835bcb9815008d37ff905bf0a5ab6fd2c7909b27bd 6c00804cb287fae4ea20429031be85c33f19ce0c7fcc3d502db7255812cbe3dd 6f47a1eb88e42d577e5ea0a5c8684747947850e371f576e666d97b14c47df57b 7c4a07184760896a6f2beff8fe19e61509dc1ab1c4868780a35e18a8c99dd61c 8484ea139304f136e20d3cb8761c4056bb6645dac1c060aab7c3555eeef92e5b 86134c033b54a8f0e79ab50a9fa15190832d9f98d4a4a9ab55a15836e75a0a4a 8cbd8f9bde8bc43f809d180766bd324f27325da69704ce9d35efdccb496d4d93 984a78c162196bc73d5df2284df0c1e3dda37aaaea52fbc5bc1cf057fe50273f 9ecbd9c2c2d9741b6fcd2a7299fbe10ade1a41745d9fba4862ce8297979a497b bddd8aed1edc9be5be172453950c8927b19c1b62f9addfef88b5ee18b8511f46 c49d85fa60b414e38184ccf347a4f64fa76a89f5ec163e41ee978bf2852fb784 d509ad4e20a5a655e8742e079c87f6befee8e3209cb8e1a7b22747bfb860132e ddfc3bec6a20fc8dd9480d13215af04f8b77e401ef43d884456b26c471797458 e3f7b2925eb9f37a52ebb6949816b8b8d8e406116f6a3ce94cfc1ac21d6a39b5 eb79e36cabb046c0d8111157b7bcec1052d3a11a721a0198d28e40a7161c1e8d f093978c0fd8d7279c09e18cd0c6e73001395ec695d92650abe29ca65790f389",
        "WTFPL": "0d9af66f48b2459f9e387a1cf36622afc469b7afe3310e235954d7936db231d4 0e22beae6d2b9bbb95d3560d39d11968dee3052d2945ecedd493ae92018b5181 0ef0281034d2dc29c794a4d7dc69a9783dcd45af6eecd54ed424125ffa8a8074 13784bd378cfff4c18d366b5858bb8ed11aff6a6e6d5fb8636f8ca9ea21f7392 265a32a9d7b791f64a5bbc0a777c79615b31fb8315c9a57d8138c117ec116f2b 33c7fcb93e52b2e835aaab0b184efb40719bb006742f709babda716885555c58 36cb106afcf0331bf44a70db0b3c282dcef111702ca74e66a3a64b09e83e9743 42842484edda2a34aa4c267d850bf7f84f74577a87af5dea814eb002d6b4681b 4822cc74df4534898e0a46195989cb6dee961d3984d28f358e1cac3bf69c8ce2 50f0e76f1332b1ede4110d93b02b70103f2a7a6dba303e3c2e088dde9c72415e 54f2b4e5f0002f38a0b33017fc6984dc789273c70f43959ff5a4559918d96819 7691192e018b6452485f8e031dbb269d5abc640b86f39555ae199c6b5711ceba 84d18810d338fc5898e020a5a9e07c825eab9e7c0f54e83c75968fbcd8369689 8741274ee4a5c24d5ba6693a657ec24cc42bd18f41541cf59b6c84e72c13a24e 9110027aae5262588efeeec4d263aed9d959cbfb21b7b4270c79e131908ea8d0 a42dadf55bf06e0ffeec564a7d7caf3cfc9b4b37232ed5540b8b62468b19a50d ae440ac126806cb662b9ae60d9eb7e380c0aa24d6fca35207bc9856a00dcc9b2 b17c1069a250eb71d9622d32f822a65172e39a76c6ea16f6180b6aad88089b24 b6b1d98bdca6bc9fef43b1b982400086f188d7fc19e18dc49c33b5cd91112777 d4e1bdb861df01fca24b102b02b1a96dc15a5a46333f4799d1a518cb06624a73 d4ed7e6a0a21b180eb3c8ecadf538582e90d2bdc148fe86f462336fa4855124a da4ee8fea88ea7d46257fb62959c838058855641ff4800173fea61b60487881e e66659e2e5345bbf918f953a628bcce03028a63f6cb53a81e47ff6d4f2611ce1 ebad948d06cefee033866fa8b6394eef42a0ea69e2adae50ac9ae5ffa3ddf6db f8db15d9471b1099d385db02cbeb6ce19552049db018f6dc0339155ed352504c",
        "Zlib": "0351d8beab0d908736d796666952b1989d06e4182934df06c67ef7f424ca9b73 1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7 2522c605da6029bd1fd7f9fa350e95333b26ae3eaa9245a65d4451cf965e4892 2e571327a12c25870134271e03afb998285dccaed49d10f5831fabe3f867abac 3847f74ebc900c350a0b61bf76ff4dd08238084f225dc0799e53b2d706bc2482 4197f545468d006daf9f6619146a974fccc7a50402c4ca4fe9ac2c4151f04053 44f4d3c35012044ee1fec3a541312d9ce7301f5f9ea20fac8caa78d789f0fb3a 45a6cd54d444e2fe0dae055ae6cbc97a2e7d070464d8b3ea9b3d8872475b59d2 4bb243762d64aa5e4990d67030ac142de10fe3647bb11ef24ed516d5210cfd19 4f5e5826111781748186734b9ebb19f15cb56934a995fabb7d11c828c5001a4b 5bdbcd3eeefa86455d35352934c8a303f1ebcf7e4102b6cd04434e76bd5531ad 719fe9b2b2742d50a5474e04f8e03642a04622355798993d9af8d2f7a1cd47e8 7d0ad6abb7d1f0bfe1395a03a50e36dff6baa878d73ecc71093b8971a9618496 7d2ba44d7fcf0719607019f3e16a5c37089ed462b655d54ff85f002c2cdd6893 8c68f8d80b1716811ec37ecaeddaeb6da880fc8c4600b7099cb1256205b5d2d4 924bde41031f170f8f427e2d942c584f45b3f9b806f4e71e56815f5f11a99c6b 99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a 9bb6ef87a76b6f9784dcb2d0e716fb5a4a23308206e6c84d91ac5b88b81a1015 9bf7f2b223f2e99905cdc4ddfe49f97f25573c671af137cce301dbcb1bd6f330 a2f1f3d4c07fda88c9259ffbf857efa57136a1d383698913eb2e33367df4cb13 a540eeefcca1526c3cb39733398e8c237f24c5925b72940043ba8770353c9413 beefb297be8214561fb1ec622aef4427528796f25bb5e54103b4be6aa036b6d5 c45c1816fdb6988a579a27d4dc86cbfb4640b35f380134a96b714de8d663bf69 c518a7c648aeb891231e662e2a0f90e29e9d31f3d81e2033d784badca496011b ddbcc2184ad0700011e7a844affad05a1526fbd0dbe837480105d78c8f13829c ea60e1c7c3713d56b82026f077dfc288cec75eec34946402f61f360b5dacb6ed ea71fce458d8d907fc2ac7388a7884d42264d24ddc77b6c7b16512e827570c0e",
    }.items()
    for digest in digests.split()
}
