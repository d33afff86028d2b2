"""Host names labelled by hand, for measuring the URL filter; none of them is trained on.

``SEEN_*`` served to choose the training's length, the share of false blocks and a few plain words; ``FRESH_*`` were written
afterwards and served for nothing but the figure.
"""

SEEN_PLAIN = """
nytimes.net pharmacy-college.net advent-church.net wikipedia.example gardeners-weekly.net
oldbridge-tours.com cityofhartwell.info northfield-hospital.net bluewater-sailing.com lakeside-dental.net
mapleleaf-schools.info quietpages.net thevillagebaker.com stonebridge-winery.com physics-today.net
openbooks.info rivertown-fire.net theskimountain.com harvest-coop.net saintpauls-parish.info
oakridge-orchestra.net greenvalley-farms.com sunriseyoga.net pinecrest-library.info cheshire-council.net
marinebiology.info weatherwatchers.net oldtimerailway.com beekeepers-guild.net westside-plumbing.com
scoutsofnorway.info antique-clocks.net folkdance-society.info cambridge-choir.net hillside-vets.com
thepaintedbird.net norfolk-broads.info glassblowers.net highland-games.info debate-club.net
credit-union.info sailmakers.com localhistory.info railway-museum.net thebreadoven.com kayak-school.net
mathcircle.info cardiology-review.net tax-advice.info shetland-wool.com lighthouse-keepers.net
sextant-navigation.net analytics-lab.info trackandfield.net adderbury-primary.info canals-of-england.net
translators-forum.info poultry-breeders.net
""".split()
SEEN_UNWANTED = """
megacasino777.com bestpokerbonus.net freeslotsnow.info betwinner24.com onlinepharmacy-pills.com
cheapviagra-rx.net hotadultcams.com xxxvideos-free.net sexchat-live.info pornhive.net spamblaster.info
bulkmail-pro.com linkfarm-seo.net adtracker-pixel.com popunder-ads.net clicktrack-ads.info
paydayloans-now.com instantcash-loans.net forexrobot-rich.info torrentking.net crackedsoft.info
keygen-world.com warez-zone.net phishkit.info trojanhost.net botnet-rent.com jackpotcity-slots.net
roulettewheel-bet.com bingobonus.net dietpills-fast.info nudecams.net escortsguide.info
backlinks-cheap.com affiliate-clicks.net bannerads-server.com quickloan-cash.net pirated-movies.info
hackedaccounts.net lottowin.info
""".split()
FRESH_PLAIN = """
brookfield-museum.net thehonestgrocer.com eastgate-cinema.info swimclub-leeds.net northsea-ferries.com
tartanweavers.net oldmill-restaurant.com stjohns-academy.info wildflower-society.net urbanplanning.info
thequietreader.com copperkettle-cafe.net fencing-league.info danish-lessons.net rosewood-furniture.com
meteorology-notes.info basketball-coaches.net thewoodturner.com parish-archives.info veteran-cars.net
speech-therapy.info legalaid-centre.net childrens-hospice.info goatfarmers.net theweeklyecho.com
astro-photos.info cycleways.net harbourmaster.info trombone-players.net peatland-trust.info
jamaica-tourism.net polishcooking.info kindergarten-songs.net soil-science.info electricians-guild.com
slow-travel.net tapestry-studio.com alpine-rescue.info housing-charity.net textile-history.info
saltmarsh-walks.net violinmakers.info public-records.net bookbinders.info ramblers-club.net
waterpolo-union.info handmade-soap.com grandparents-network.net voting-guide.info mechanics-institute.net
betterhomes-garden.com crackerbakery.com essex-cricket.info hackathon-students.net
expertgardeners.com classicsessions.net
""".split()
FRESH_UNWANTED = """
royalcasino-vip.com pokerstakes.net slotmania-free.info bestbetting-odds.com jackpots-daily.net
blackjack-online.info generic-cialis.net painkillers-rx.com botoxcheap.info steroidstore.net xxx-tube.info
adultfriend-cams.net freesexvideos.com eroticstories.net milf-dating.info seo-spammer.net
buybacklinks-now.com doorwaypages.info clickbaitnews.net adserver-zone.com popunder-network.info
tracking-pixel.net bannerclicks.com payday-cash.info fastloans247.com forexmillion.net getrichquick.info
torrentsite.net crackserial.info nulledscripts.com keygens-free.net warezforum.info pirateproxy.net
phishing-login.info malwaredrop.net trojan-builder.com keyloggerpro.net virusdownload.info
hacktools-exploit.com
""".split()
