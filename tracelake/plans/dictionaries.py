"""Name dictionaries of the analytical queries. Results depend on each entry."""

CORE_PROCESSES = "System Registry smss.exe csrss.exe wininit.exe services.exe lsass.exe svchost.exe explorer.exe dwm.exe".split()
SYNC_CLIENTS = ["onedrive", "googledrive", "google drive", "icloud", "dropbox"]
SYSTEM = """system registry smss.exe csrss.exe wininit.exe winlogon.exe services.exe lsass.exe lsm.exe svchost.exe explorer.exe
userinit.exe dwm.exe taskhost.exe taskhostw.exe taskeng.exe spoolsv.exe searchindexer.exe searchprotocolhost.exe wmiprvse.exe
mmc.exe gpscript.exe runonce.exe conhost.exe dllhost.exe""".split()
SHELLS = "cmd.exe powershell.exe pwsh.exe".split()
LAUNCHERS = """explorer.exe cmd.exe powershell.exe pwsh.exe userinit.exe mmc.exe services.exe svchost.exe taskeng.exe taskhost.exe
wmiprvse.exe gpscript.exe""".split()
FORKERS = "svchost.exe dllhost.exe conhost.exe wmiprvse.exe taskhostw.exe".split()
DENYLIST = """system registry smss.exe csrss.exe wininit.exe winlogon.exe services.exe lsass.exe lsm.exe svchost.exe explorer.exe
userinit.exe dwm.exe taskhost.exe taskhostw.exe taskeng.exe spoolsv.exe searchindexer.exe searchprotocolhost.exe
searchfilterhost.exe wmiprvse.exe wmiadap.exe mmc.exe conhost.exe dllhost.exe runonce.exe rundll32.exe regsvr32.exe msiexec.exe
wuauclt.exe wuapp.exe trustedinstaller.exe mscorsvw.exe ngen.exe drvinst.exe rdpclip.exe ie4uinit.exe ielowutil.exe iexplore.exe
msfeedssync.exe mrt.exe mrtstub.exe wermgr.exe werfault.exe wsqmcons.exe sppsvc.exe consent.exe logonui.exe lpremove.exe
mcbuilder.exe helper.exe setup.exe aitagent.exe control.exe csc.exe cvtres.exe defrag.exe powercfg.exe vds.exe vdsldr.exe
vssvc.exe taskmgr.exe tstheme.exe unregmp2.exe gpscript.exe eudcsettings.exe invalidatefntcache.exe iscsicpl.exe lodctr.exe
unlodctr.exe makecab.exe mdsched.exe mofcomp.exe mpsyschk.exe msconfig.exe mstsc.exe notepad.exe odbcad32.exe
rebuildsearchindex.exe regtlibv12.exe calc.exe magnify.exe sdclt.exe sdiagnhost.exe sidebar.exe winmail.exe dvdmaker.exe
ehshell.exe plasrv.exe osppsvc.exe bfsvc.exe compmgmtlauncher.exe cleanup.exe isbew64.exe mspaint.exe snippingtool.exe
stikynot.exe wfs.exe xpsrchvw.exe wmplayer.exe eudcedit.exe cmd.exe java.exe javaw.exe jucheck.exe jusched.exe
chrome_updater.exe verclsid.exe tweetdeck.exe skypeicon.exe wordicon.exe outicon.exe shdocvw.dll shext.dll ieframe.dll
mydocs.dll twext.dll zipfldr.dll acroiehelpershim.dll mcieplg.dll mcshield.exe mctray.exe mcupdate.exe mcscript_inuse.exe
mcsacore.exe mfeann.exe mfefire.exe mfevtps.exe firesvc.exe firetray.exe frameworkservice.exe naprdmgr.exe shstat.exe
udaterui.exe vstskmgr.exe framepkg.exe frminst.exe entvutil.exe mctadmin.exe scan32.exe scan64.exe vmwareservice.exe
vmwaretray.exe vmwareuser.exe vmupgradehelper.exe vmtoolsd.exe vmacthlp.exe adobearm.exe reader_sl.exe acrord32.exe armsvc.exe
googleupdate.exe googlecrashhandler.exe chrome.exe firefox.exe skype.exe outlook.exe winword.exe excel.exe f-response-ent.exe
f-response-lm-srv.exe fresdisk.sys fresdiskl.sys mnemosyne_x64.sys mnemosynei386.sys usboesrv.exe usboebusdrv.sys usboedrv.sys
usboeloaderdrv.sys""".split()
DENYLIST_PREFIXES = "windows-kb ndp40-kb vcredist sae setup mc mfe".split()
DUAL_USE = """at.exe net.exe net1.exe wmic.exe reg.exe sc.exe schtasks.exe tasklist.exe ipconfig.exe whoami.exe nltest.exe quser.exe
netstat.exe systeminfo.exe vssadmin.exe cscript.exe wscript.exe ping.exe""".split()
OFFENSIVE = """psexec.exe psexesvc.exe mimikatz.exe wce.exe gsecdump.exe pwdump.exe fgdump.exe procdump.exe sdelete.exe nc.exe ncat.exe
netcat.exe winexe.exe""".split()
CREDENTIAL_PATTERNS = """mimikatz katz mimilib sekurlsa lsadump gsecdump pwdump fgdump wce lazagne samdump creddump cachedump hashdump
procdump dumpert nanodump safetykatz""".split()
